"""Spark-native analytics over noisy ordered event records."""

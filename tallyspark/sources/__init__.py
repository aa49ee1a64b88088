"""Scans, checks of what was scanned, and sinks."""

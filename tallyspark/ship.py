"""Send this package to the executors, for sessions whose workers don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's sources goes out by addPyFile."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-"), "tallyspark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(ROOT):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("tallyspark", os.path.relpath(full, ROOT)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)

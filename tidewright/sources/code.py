"""Makes this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package, zipped, to the application once; Spark hands it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it lives
        path = os.path.join(folder, "tidewright_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        z.write(f := os.path.join(folder, n), os.path.relpath(f, os.path.dirname(top)))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark

"""Gives the Python workers of an application this package."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application. Spark's own file server carries it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    build = tempfile.mkdtemp(prefix="code-")
    copy = os.path.join(build, "src", root.name)
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(build, root.name), "zip", os.path.dirname(copy), root.name))
    # the worker of a stream in the driver's place gets no files, but this environment
    before = spark.sparkContext.environment.get("PYTHONPATH")
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([str(root.parent), *([before] if before else [])])
    _shipped.add(app)

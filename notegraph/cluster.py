"""Delivery of this package to the executors, whose Python workers import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_delivered: set[str] = set()


def deliver(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once."""
    application = spark.sparkContext.applicationId
    if application in _delivered:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="notegraph-")) / "notegraph_package.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _delivered.add(application)

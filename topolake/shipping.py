"""Puts this package on the executors' import path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Once an application: add the package's sources as a zip, so that Python workers can import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_topolake_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="topolake-"), "topolake.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for file in sorted(PACKAGE.rglob("*.py")):
            bundle.write(file, file.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._topolake_shipped = True
    return spark

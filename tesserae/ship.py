"""Executors need this package for the functions that run in Python; a cluster does not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_tesserae_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tesserae-package-")) / "tesserae.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, Path(home.name) / file.relative_to(home))
    sc.addPyFile(str(path))
    sc._tesserae_shipped = True

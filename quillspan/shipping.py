"""Make this package importable by Python workers wherever the driver imported it from."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, unless their path already has it."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="quillspan-ship-")
    copy = Path(folder, "tree")
    shutil.copytree(ROOT / "quillspan", copy / "quillspan", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quillspan", "zip", copy))
    shutil.rmtree(copy)
    _shipped.add(spark.sparkContext.applicationId)

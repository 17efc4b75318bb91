"""Operators of a training-data pipeline on Spark."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it.

    Workers that have the package otherwise (installed, or by ``--py-files``) are not affected.
    """
    root = str(Path(__file__).resolve().parent.parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark

"""Python workers and this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, unless their path already has it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)

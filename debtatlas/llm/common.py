"""What several operators share: reading tables and settling steps."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from debtatlas.session import scratch_folder, settle, steps

__all__ = ["reach_workers", "scratch_folder", "settle", "steps", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    A cluster ships the package with ``--py-files``; there the extra folder is just absent.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))

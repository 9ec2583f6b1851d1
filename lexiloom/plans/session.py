"""What a session needs for the package's Python functions."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package when the driver got it through sys.path alone."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local one only for a local master, which has no other hosts."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or 'file:///tmp/checkpoints'}/lexiloom-{uuid.uuid4().hex}"

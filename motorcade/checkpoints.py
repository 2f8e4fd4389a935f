"""Checkpoint folder of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names. Where it is unset a temporary one is set, if driver and executors are
    one machine (tests); on a cluster that would lose data."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="motorcade-"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, where all executors can read it."""
    import uuid

    ensure(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

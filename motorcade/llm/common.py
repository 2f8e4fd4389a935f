"""Shared-folder tables and small helpers for the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. Where it is unset a temporary one is set, if driver and executors
    are one machine (tests); on a cluster that would lose data."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="motorcade-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Bounds on what a Python worker holds of its input at a time, set where the session has Spark's defaults.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same frame, with the session's Arrow batches bounded in rows and bytes, since texts may be long."""
    conf = df.sparkSession.conf
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES)):
        now = conf.get(key, None)
        if now in (None, default) or (default is None and now.isdigit() and int(now) > value):
            conf.set(key, str(value))
    return df


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motorcade/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._motorcade_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables that `written` made and nothing needs any more."""
    for df in frames:
        path = getattr(df, "_motorcade_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def id_crc(col: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Sources: request bodies, registries, archives, and streams of files or topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorcade.schemas import CANONICAL, RAW, REGISTRY


def ndjson(spark: SparkSession, path: str, oem: str) -> DataFrame:
    """Batch files of one event per line as raw payloads; blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.lit(oem).alias("oem"), F.lit(None).cast("int").alias("schema_ver"), F.unix_millis(F.current_timestamp()).alias("recv_ms"), F.col("value").alias("raw"))


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle registry with a header; malformed lines are dropped."""
    return spark.read.schema(REGISTRY).csv(path, header=True, mode="DROPMALFORMED")


def archive(spark: SparkSession, path: str, tenant: int | None = None, day: str | None = None, hour: int | None = None) -> DataFrame:
    """Cold telemetry; the three partition columns prune folders."""
    df = spark.read.parquet(path)
    for c, v in (("tenant", tenant), ("date", day), ("hour", hour)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def raw_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Stream of raw payload files (JSON rows of RAW); per_trigger is the back-pressure bound."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", per_trigger).json(path)


def canonical_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", per_trigger).parquet(path)


def topic(spark: SparkSession, servers: str, name: str, per_trigger: int = 500_000) -> DataFrame:
    """Stream of a message topic, keyed by vehicle. Needs Spark's Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("maxOffsetsPerTrigger", per_trigger)
    return stream.load().select(F.col("key").cast("string"), F.col("value").cast("string").alias("raw"), "timestamp", "partition", "offset")


def avro_records(df: DataFrame, schema_json: str, col: str = "value") -> DataFrame:
    """Binary records of a fixed schema as columns. Needs Spark's Avro package on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return df.select(from_avro(col, schema_json).alias("r")).select("r.*")

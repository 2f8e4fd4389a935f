"""Streaming: normalised payloads to clean events and facts, with exactly-once file sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motorcade.operators.mapping import Registry
from motorcade.operators.normalize import accepted, normalize, rejected
from motorcade.operators.trips import finished
from motorcade.sources.writers import batch_written, dead_letters
from motorcade.streaming.processors import REORDERED, TRIPS, Reorder, Trips

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """State on disk rather than on the heap, which custom stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def deduplicated(events: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Exact deduplication with state that goes after the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rollup_10s(events: DataFrame, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    w = F.window(ts, "10 seconds")
    return events.withWatermark(ts, delay).groupBy("tenant_id", "vehicle_pid", w.alias("w")).agg(F.avg("speed_kmh").alias("avg_speed"), F.max("speed_kmh").alias("max_speed"), F.max_by("lat_e6", ts).alias("lat_e6"), F.max_by("lon_e6", ts).alias("lon_e6"), F.min("soc_pct").alias("min_soc"))


def reordered(events: DataFrame) -> DataFrame:
    """events: columns of REORDERED without late, and arrival."""
    return events.groupBy("vehicle_pid").transformWithStateInPandas(Reorder(), REORDERED, "Append", "ProcessingTime")


def trips(clean: DataFrame) -> DataFrame:
    return finished(clean.groupBy("vehicle_pid").transformWithStateInPandas(Trips(), TRIPS, "Append", "None"))


def ingest(raw: DataFrame, registry: DataFrame, mappings: Callable[[], Registry], clean_path: str, dead_path: str, checkpoint: str) -> StreamingQuery:
    """Raw payloads to canonical rows and dead letters. `mappings` is asked at each micro-batch, so a new version of a
    mapping takes effect without a restart; folders are keyed by batch, so a retried batch counts once."""

    def one(batch: DataFrame, batch_id: int) -> None:
        done = normalize(batch, registry, mappings()).persist()
        batch_written(accepted(done), batch_id, clean_path)
        batch_written(dead_letters(rejected(done)), batch_id, dead_path)
        done.unpersist()

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, clean_path: str, late_path: str, checkpoint: str) -> StreamingQuery:
    """Reordered events to two tables by their late flag."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch_written(batch.where("not late"), batch_id, clean_path)
        batch_written(batch.where("late"), batch_id, late_path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

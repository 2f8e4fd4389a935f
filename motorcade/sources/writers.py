"""Sinks. Each is safe to repeat: a retried batch overwrites what its first try wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorcade.operators.joins import keep_first, keep_last, merged


def archived(df: DataFrame, path: str, ts_ms: str = "ts_ms", tenant: str = "tenant_id", mode: str = "append") -> None:
    """Hourly archive: folders by tenant, date and hour, rows by vehicle and time, zstd."""
    t = F.timestamp_millis(ts_ms)
    rows = df.withColumn("tenant", F.col(tenant)).withColumn("date", F.to_date(t)).withColumn("hour", F.hour(t))
    # hours of one tenant go to one writer each unless they are large: the rebalance may split them
    rows = rows.hint("rebalance", "tenant", "date", "hour").sortWithinPartitions("tenant", "date", "hour", "vehicle_pid", ts_ms)
    rows.write.mode(mode).partitionBy("tenant", "date", "hour").option("compression", "zstd").parquet(path)


def batch_written(df: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch as its own folder, overwritten on a retry, so that each batch counts once."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def tsv_line(df: DataFrame) -> Column:
    """Tab-separated line of all columns: nulls as \\N, arrays in brackets, and tab, line ends, backslash and quote escaped."""

    def escaped(c: Column) -> Column:
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("'", "\\'")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), escaped(x.cast("string")), F.lit("'"))), ","), F.lit("]"))
        elif kind == "timestamp":
            text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind == "boolean":
            text = c.cast("int").cast("string")
        else:
            text = escaped(c.cast("string"))
        cols.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("\t", *cols)


def dead_letters(df: DataFrame) -> DataFrame:
    """Rejected payloads as JSON with their reasons."""
    return df.select(F.to_json(F.struct("oem", "raw", "reason_code", "recv_ms")).alias("value"), "reason_code")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Table after an upsert by keys; of rows with equal keys the last in order stays."""
    return keep_last(existing.unionByName(new), keys, order)


def inserted(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Table after an insert that leaves rows with known keys alone."""
    return existing.unionByName(keep_first(existing, new, keys, order))


def documents_upserted(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    return merged(old, new, key, created)

"""Sharing with privacy: aggregates behind anonymity rules, budgets, erasure, and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from motorcade.functions.privacy import laplace, uniform

PRODUCTS = {"TRAFFIC_DENSITY": 6, "MOBILITY_FLOW": 5}


def bounded(df: DataFrame, key: str, most: int, by: list[str]) -> DataFrame:
    """At most `most` rows of each key, those of smallest hash: the bound on what one vehicle adds to a release."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(key, *by), *by)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def anonymous(df: DataFrame, group: list[str], key: str, value: str, k: int = 10, dominance: float = 0.5) -> DataFrame:
    """Groups of at least k keys in which no key makes more than `dominance` of the value."""
    per = df.groupBy(*group, key).agg(F.sum(value).alias("_v"))
    out = per.groupBy(*group).agg(F.count("*").alias("keys"), F.sum("_v").alias(value), F.max("_v").alias("_max"))
    return out.where((F.col("keys") >= k) & (F.col("_max") <= dominance * F.col(value))).drop("_max")


def shared_cells(cells: DataFrame, product: str, precision: int, epsilon: float, secret: str, k: int = 5, dominance: float = 0.5) -> DataFrame:
    """A data product: vehicles per cell and hour at a precision the product allows, anonymous, with noise that is the
    same whenever the same cell is asked for. cells: vehicle_pid, geohash, hour."""
    if product not in PRODUCTS:
        raise ValueError("unknown product")
    if precision > PRODUCTS[product]:
        raise ValueError("precision is finer than the product allows")
    one = cells.select("vehicle_pid", F.substr("geohash", F.lit(1), F.lit(precision)).alias("cell"), "hour").distinct().withColumn("vehicles", F.lit(1))
    safe = anonymous(one, ["cell", "hour"], "vehicle_pid", "vehicles", k, dominance).drop("keys")
    noisy = laplace(F.col("vehicles").cast("double"), 1.0, epsilon, uniform(secret, F.col("cell"), F.col("hour")))
    return safe.withColumn("noisy", F.greatest(F.lit(0.0), noisy))


def within_budget(requests: DataFrame, cap: float = 10.0) -> DataFrame:
    """Requests (agreement, day, ts_ms, epsilon) with what was spent up to each, and whether it still fits the day's cap."""
    w = Window.partitionBy("agreement", "day").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("spent", F.sum("epsilon").over(w)).withColumn("granted", F.col("spent") <= cap + 1e-9)


def erased(df: DataFrame, subjects: DataFrame, key: str = "vehicle_pid") -> DataFrame:
    return df.join(subjects, key, "left_anti")


def erasure_report(tables: dict[str, DataFrame], subjects: DataFrame, key: str = "vehicle_pid") -> DataFrame:
    """Per table, rows in which a subject is left: none, if erasure is complete."""
    out = None
    for name, df in tables.items():
        part = df.join(subjects, key, "left_semi").agg(F.count("*").alias("left")).select(F.lit(name).alias("table"), "left", (F.col("left") == 0).alias("clean"))
        out = part if out is None else out.unionByName(part)
    return out


def link(previous: str, payload: str) -> str:
    return hashlib.sha256(f"{previous}:{payload}".encode()).hexdigest()


def chained(entries: DataFrame, tenant: str = "tenant_id", order: str = "seq", payload: str = "payload") -> DataFrame:
    """Audit entries with their hash over the one before: H = sha256(H_before:payload), from 64 zeros. One chain per tenant."""
    rows = entries.where(F.col(tenant).isNotNull()).select(tenant, F.col(order).cast("bigint").alias(order), payload)
    schema = StructType([*rows.schema.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())])
    arrow = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last = None, ""
        for b in batches:
            hashes = []
            for t, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t != who:
                    who, last = t, "0" * 64
                hashes.append((last, link(last, text)))
                last = hashes[-1][1]
            before, after = zip(*hashes, strict=True) if hashes else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], schema=arrow)

    return rows.repartition(tenant).sortWithinPartitions(tenant, order).mapInArrow(go, schema)


def verified_chain(log: DataFrame, tenant: str = "tenant_id", order: str = "seq", payload: str = "payload") -> DataFrame:
    """Per tenant, entries and how many don't follow from the stored entry before: no sequential pass is needed to verify."""
    w = Window.partitionBy(tenant).orderBy(order)
    before = F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))
    own = F.sha2(F.concat_ws(":", "prev_hash", F.col(payload)), 256)
    bad = (F.col("prev_hash") != before) | (F.col("hash") != own)
    return log.withColumn("_bad", bad).groupBy(tenant).agg(F.count("*").alias("entries"), F.count_if("_bad").alias("broken"))

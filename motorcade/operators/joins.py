"""Enrichment joins. Join strategies are left to the optimizer, which broadcasts a side only under its size threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorcade.checkpoints import folder
from motorcade.functions.geo import EARTH_M, haversine


def split_known(df: DataFrame, registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the registry's columns, rows that the registry lacks)."""
    return df.join(registry, key), df.join(registry, key, "left_anti")


def in_interval(df: DataFrame, spans: DataFrame, key: str, ts: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows with the interval that holds their time; a null end is open. Equi-join on the key, the range as residual."""
    return df.join(spans, key).where((F.col(ts) >= F.col(start)) & (F.col(end).isNull() | (F.col(ts) < F.col(end))))


def as_of(df: DataFrame, prices: DataFrame, key: str, ts: str, valid_from: str, value: str) -> DataFrame:
    """Rows with the last value set at or before their time, null where there was none.

    Union and a running last value: one shuffle on the key, no range join, and no blow-up however many prices a key has."""
    cols = df.columns
    left = df.withColumn("_at", F.col(ts)).withColumn("_v", F.lit(None).cast(prices.schema[value].dataType)).withColumn("_row", F.lit(1))
    right = prices.select(*[F.col(key) if c == key else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols], F.col(valid_from).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("_v", True).over(w)).where("_row = 1").select(*cols, value)


def with_intervals(prices: DataFrame, key: str, valid_from: str) -> DataFrame:
    """Each row with the time the next one of its key takes over."""
    return prices.withColumn("valid_to", F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from)))


def tariff_periods(df: DataFrame, periods: DataFrame, ts_ms: str = "ts_ms") -> DataFrame:
    """Rows with the tariff period of their minute of the day and day of the week (bit 0 is Monday)."""
    t = F.timestamp_millis(ts_ms)
    df = df.withColumn("minute", F.hour(t) * 60 + F.minute(t)).withColumn("dow_bit", F.pow(F.lit(2), F.weekday(t)).cast("int"))
    return df.join(periods, (F.col("minute") >= F.col("start_min")) & (F.col("minute") < F.col("end_min")) & (F.col("dow_mask").bitwiseAND(F.col("dow_bit")) > 0))


def with_latest(keys: DataFrame, facts: DataFrame, key: str, order: list[Column], cols: list[str]) -> DataFrame:
    """Each key with its latest fact (nulls where it has none), by one aggregate rather than a lookup per key."""
    best = facts.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
    return keys.join(best, key, "left")


def nearest(points: DataFrame, places: DataFrame, k: int, point_id: str, place_id: str, finest: int = 13) -> DataFrame:
    """The k nearest places of each point (both with lat and lon): point_id, place_id, distance and rank.

    Points meet the places of their own and the eight cells around, of a grid of 2**finest columns. Points whose k-th
    place lies within a cell's width are done; the others go on with cells of twice the size."""
    spark = points.sparkSession
    done, left = [], points.select(point_id, F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    places = places.select(place_id, "lat", "lon")
    w = Window.partitionBy(point_id).orderBy("distance", place_id)
    for bits in range(finest, -1, -1):
        n, size = 1 << bits, 360.0 / (1 << bits)
        cell = lambda lat, lon: (F.floor((F.col(lat) + 90) / size), F.pmod(F.floor((F.col(lon) + 180) / size), F.lit(n)))  # noqa: B023, E731
        y, x = cell("plat", "plon")
        around = F.array_distinct(F.array(*[F.struct((y + dy).alias("y"), F.pmod(x + dx, F.lit(n)).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
        cy, cx = cell("lat", "lon")
        met = left.withColumn("c", F.explode(around)).select(point_id, "plat", "plon", "c.*").join(places.withColumns({"y": cy, "x": cx}), ["y", "x"])
        met = met.withColumn("distance", haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        path = folder(spark, "nearest")
        met.select(point_id, place_id, "distance", "rank", "plat", "plon").write.parquet(path)
        met = spark.read.parquet(path)
        if not bits:
            done.append(met)
            break
        # what no cell around holds lies at least a cell's width away; degrees of longitude shrink towards the poles
        near = F.radians(F.lit(0.99 * size)) * EARTH_M * F.cos(F.radians(F.least(F.lit(90.0), F.abs("plat") + size)))
        full = met.where((F.col("rank") == k) & (F.col("distance") <= near)).select(point_id)
        done.append(met.join(full, point_id, "left_semi"))
        left = left.join(full, point_id, "left_anti")
        path = folder(spark, "points")
        left.write.parquet(path)
        left = spark.read.parquet(path)
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(point_id, place_id, "distance", "rank")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: expected, landed and distinct ids, missing, unexpected and duplicate ones, from one full outer join of counts per id."""
    e = expected.groupBy(key, value).agg(F.count("*").alias("e"))
    a = actual.groupBy(key, value).agg(F.count("*").alias("a"))
    both = e.join(a, [key, value], "full_outer").withColumn("e", F.coalesce("e", F.lit(0))).withColumn("a", F.coalesce("a", F.lit(0)))
    return both.groupBy(key).agg(
        F.count_if(F.col("e") > 0).alias("expected"),
        F.sum("a").alias("landed"),
        F.count_if(F.col("a") > 0).alias("landed_distinct"),
        F.count_if((F.col("e") > 0) & (F.col("a") == 0)).alias("missing"),
        F.count_if((F.col("e") == 0) & (F.col("a") > 0)).alias("unexpected"),
        F.sum(F.greatest(F.col("a") - 1, F.lit(0))).alias("duplicates"),
    )


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert that replaces: the row of greatest order of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def keep_first(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert that does nothing on conflict: new rows whose key isn't there yet, the first of each."""
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")


def merged(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """Upsert by key in which the first creation time stays."""
    o = old.select(key, F.col(created).alias("_created"), *[F.col(c).alias(f"_{c}") for c in old.columns if c not in (key, created)])
    j = new.join(o, key, "full_outer")
    rest = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in new.columns if c not in (key, created)]
    return j.select(key, F.coalesce("_created", created).alias(created), *rest)

"""Telemetry and dimensions over the star-schema tables, and the same in DuckDB SQL.

Users are vehicles. Time is compressed 600 times, which gives gaps of seconds to minutes between a vehicle's samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0_MS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    code = F.when(k < 10, "P0301").when(k < 20, "P0420").when(k < 25, "C0035").when(k < 30, "U0100")
    charging = F.col("event_type").isin("purchase", "click")
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("vehicle_pid"),
        (F.col("user_id") % 5).cast("int").alias("tenant_id"),
        F.col("event_id").alias("seq"),
        (F.lit(T0_MS) + F.floor((us - F.lit(T0_MS * 1000)) / 600_000.0).cast("bigint")).alias("ts_ms"),
        k.alias("k"),
        F.greatest(F.col("value") - 20.0, F.lit(0.0)).alias("speed_kmh"),
        (F.col("event_type") != "signup").alias("ignition"),
        F.when(charging, F.col("value") / 10.0).otherwise(0.0).alias("charge_kw"),
        F.when(charging, "CHARGING").otherwise("NONE").alias("charge_state"),
        k.cast("double").alias("soc_pct"),
        ((k * 37) % 360).alias("heading_deg"),
        (F.lit(13_000_000) + (F.col("user_id") % 97) * 1000 + k * 45).cast("int").alias("lat_e6"),
        (F.lit(80_200_000) + (F.col("user_id") % 89) * 1200 + k * 55).cast("int").alias("lon_e6"),
        F.lit(None).cast("int").alias("rpm"),
        F.when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<string>")).alias("dtc"),
    )


TELEMETRY = f"""t AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS vehicle_pid, CAST(user_id % 5 AS INTEGER) AS tenant_id, event_id AS seq,
    {T0_MS} + CAST(floor((epoch_us(ts) - {T0_MS}000) / 600000.0) AS BIGINT) AS ts_ms, k,
    greatest(value - 20.0, 0.0) AS speed_kmh, event_type <> 'signup' AS ignition,
    CASE WHEN event_type IN ('purchase', 'click') THEN value / 10.0 ELSE 0.0 END AS charge_kw,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'CHARGING' ELSE 'NONE' END AS charge_state,
    CAST(k AS DOUBLE) AS soc_pct, (k * 37) % 360 AS heading_deg,
    CAST(13000000 + (user_id % 97) * 1000 + k * 45 AS INTEGER) AS lat_e6,
    CAST(80200000 + (user_id % 89) * 1200 + k * 55 AS INTEGER) AS lon_e6,
    CASE WHEN k < 10 THEN 'P0301' WHEN k < 20 THEN 'P0420' WHEN k < 25 THEN 'C0035' WHEN k < 30 THEN 'U0100' END AS code
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""


def geohash_sql(lat: str, lon: str, precision: int) -> str:
    """DuckDB expression of a geohash, letter by letter from the bits of the two cell numbers."""
    total = 5 * precision
    nx, ny = (total + 1) // 2, total // 2
    x, y = f"CAST(floor(({lon} + 180.0) / 360.0 * {1 << nx}) AS BIGINT)", f"CAST(floor(({lat} + 90.0) / 180.0 * {1 << ny}) AS BIGINT)"
    letters = []
    for c in range(precision):
        bits = [f"((({x}) >> {nx - 1 - b // 2}) & 1) * {16 >> (b - 5 * c)}" if b % 2 == 0 else f"((({y}) >> {ny - 1 - b // 2}) & 1) * {16 >> (b - 5 * c)}" for b in range(5 * c, 5 * c + 5)]
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} AS INTEGER) + 1, 1)")
    return "(" + " || ".join(letters) + ")"


def uuid3_sql(text: str) -> str:
    h = f"md5(unhex(sha256({text})))"
    return f"(substr({h},1,8) || '-' || substr({h},9,4) || '-3' || substr({h},14,3) || '-' || substr('89ab89ab89ab89ab', CAST(instr('0123456789abcdef', substr({h},17,1)) AS INTEGER), 1) || substr({h},18,3) || '-' || substr({h},21,12))"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6_371_000.0) -> str:
    return f"(2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"


def r(x: str, places: int = 3) -> str:
    """Rounded half up, as both engines give it."""
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def rc(x, places: int = 3):
    return F.floor(x * float(10**places) + 0.5) / float(10**places)

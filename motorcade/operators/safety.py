"""Harsh events from speed and heading deltas, with a cooldown, and driver scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorcade.config import SAFETY, SCORE, SafetyConfig, ScoreConfig
from motorcade.functions.ids import uuid3
from motorcade.operators.lockstep import Cooldown, run

WEIGHTS = {"HARSH_BRAKE": 3.0, "HARSH_ACCEL": 2.0, "HARSH_CORNER": 2.0}


def deltas(telemetry: DataFrame, key: str = "vehicle_pid") -> DataFrame:
    """Samples with a speed, with dt_ms, accel_ms2 and turn_deg_s against the one before; the heading compared with is the last that wasn't null, 0 where there was none."""
    w = Window.partitionBy(key).orderBy("ts_ms", "seq")
    before = F.coalesce(F.last("heading_deg", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = telemetry.where(F.col("speed_kmh").isNotNull())
    df = df.withColumn("dt_ms", F.col("ts_ms") - F.lag("ts_ms").over(w)).withColumn("dv", F.col("speed_kmh") - F.lag("speed_kmh").over(w)).withColumn("_turn", F.abs(F.col("heading_deg") - before))
    turn = F.when(F.col("_turn") > 180, 360 - F.col("_turn")).otherwise(F.col("_turn"))
    seconds = F.when(F.col("dt_ms") > 0, F.col("dt_ms") / 1000.0)
    return df.withColumn("accel_ms2", F.col("dv") / 3.6 / seconds).withColumn("turn_deg_s", turn / seconds).drop("dv", "_turn")


def candidates(telemetry: DataFrame, c: SafetyConfig = SAFETY) -> DataFrame:
    """Samples that would raise an event if no cooldown held: first of brake, acceleration, and then corner where fast with a heading, else overspeed."""
    df = deltas(telemetry).where(F.col("dt_ms").between(c.min_dt_ms, c.max_dt_ms))
    a, v = F.col("accel_ms2"), F.col("speed_kmh")
    turns = (v >= c.corner_kmh) & F.col("heading_deg").isNotNull()
    kind = F.when(a <= c.brake_ms2, "HARSH_BRAKE").when(a >= c.accel_ms2, "HARSH_ACCEL").when(turns, F.when(F.col("turn_deg_s") >= c.turn_deg_s, "HARSH_CORNER")).when(v > c.limit_kmh + c.over_kmh, "OVERSPEED")
    df = df.withColumn("event_type", kind).where("event_type is not null")
    severity = F.when(F.col("event_type") == "HARSH_CORNER", F.col("turn_deg_s")).when(F.col("event_type") == "OVERSPEED", v - c.limit_kmh).otherwise(F.abs(a))
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    weight = F.coalesce(F.try_element_at(weights, F.col("event_type")), 1.0 + (v - c.limit_kmh) / 10.0)
    return df.withColumn("severity", severity).withColumn("weight", weight)


def cooled(df: DataFrame, cooldown_ms: int, key: str = "vehicle_pid", strict: bool = False) -> DataFrame:
    """Rows kept when the last kept one of the same key is at least (or, if strict, more than) cooldown_ms back. Columns stay.

    Only candidates reach the sequential pass, and it holds one time per key."""
    return run(df, key, ["ts_ms", "seq"], Cooldown(cooldown_ms, strict), df.columns)


def safety_events(telemetry: DataFrame, c: SafetyConfig = SAFETY) -> DataFrame:
    """Events after the cooldown, which holds across types."""
    cols = ["vehicle_pid", "tenant_id", "ts_ms", "seq", "event_type", "severity", "speed_kmh", "accel_ms2", "weight"]
    kept = cooled(candidates(telemetry, c).select(*cols), c.cooldown_ms)
    return kept.withColumn("event_id", uuid3(F.concat_ws(":", "vehicle_pid", F.col("ts_ms").cast("string"), "event_type")))


def overspeed_episodes(telemetry: DataFrame, limit: Column, factor: float = 1.1, least_s: float = 10.0) -> DataFrame:
    """Runs above factor times the limit that last least_s up to the first sample below; the excess is the run's greatest."""
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")
    df = telemetry.withColumn("over", F.col("speed_kmh") > limit * factor).withColumn("excess", F.col("speed_kmh") - limit)
    df = df.withColumn("island", F.sum(F.when(F.col("over") != F.coalesce(F.lag("over").over(w), ~F.col("over")), 1).otherwise(0)).over(w)).withColumn("next_ms", F.lead("ts_ms").over(w))
    runs = df.where("over").groupBy("vehicle_pid", "island").agg(F.min("ts_ms").alias("start_ms"), F.max("next_ms").alias("end_ms"), F.count(F.when(F.col("next_ms").isNull(), 1)).alias("open"), F.max("excess").alias("over_kmh"))
    return runs.where(F.col("end_ms").isNotNull() & (F.col("open") == 0) & ((F.col("end_ms") - F.col("start_ms")) / 1000.0 >= least_s)).withColumn("weight", 1.0 + F.col("over_kmh") / 10.0).drop("island", "open")


def decayed(weight: Column, ts_ms: Column, at_ms: Column, half_life_days: float) -> Column:
    """Weight halved for each half life between its time and another."""
    return weight * F.pow(F.lit(2.0), -(at_ms - ts_ms) / (half_life_days * 86_400_000.0))


def driver_scores(events: DataFrame, distances: DataFrame, at_ms: int, c: ScoreConfig = SCORE, key: str = "driver") -> DataFrame:
    """Scores at a time: decayed weights W and kilometres K in closed form, R = W / (K / 100), 100 * exp(-R / r0); 100 under min_km.

    events: key, event_type, weight, ts_ms; distances: key, km, ts_ms. Contributions by type and the largest one's hint."""
    now = F.lit(at_ms)
    w = events.where(F.col("ts_ms") <= at_ms).groupBy(key, "event_type").agg(F.sum(decayed(F.col("weight"), F.col("ts_ms"), now, c.half_life_days)).alias("w"))
    w = w.groupBy(key).agg(F.sum("w").alias("w"), F.max_by("event_type", F.struct(F.col("w"), F.col("event_type"))).alias("top_risk"))
    k = distances.where(F.col("ts_ms") <= at_ms).groupBy(key).agg(F.sum(decayed(F.col("km"), F.col("ts_ms"), now, c.half_life_days)).alias("km"))
    df = k.join(w, key, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    rate = F.when(F.col("km") >= c.min_km, F.col("w") / (F.col("km") / 100.0)).otherwise(0.0)
    score = F.when(F.col("km") >= c.min_km, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.exp(-rate / c.r0)))).otherwise(100.0)
    return df.withColumn("rate", rate).withColumn("score", score).withColumn("risky", (F.col("km") >= c.min_km) & (F.col("score") < c.risky))

"""Aggregations over time, vehicle, driver, tenant and map cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def bucket(ts_ms: str, width_ms: int) -> Column:
    return F.col(ts_ms) - F.pmod(F.col(ts_ms), F.lit(width_ms))


def rollup_10s(telemetry: DataFrame) -> DataFrame:
    """Per tenant, vehicle and 10 s: mean and greatest speed, last position that isn't null, least charge."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts_ms", "seq"))).alias(f"last_{c}")
    return telemetry.groupBy("tenant_id", "vehicle_pid", bucket("ts_ms", 10_000).alias("bucket_ms")).agg(F.avg("speed_kmh").alias("avg_speed"), F.max("speed_kmh").alias("max_speed"), last("lat_e6"), last("lon_e6"), F.min("soc_pct").alias("min_soc"))


def minute_summary(telemetry: DataFrame, most_gap_ms: int = 300_000) -> DataFrame:
    """Per vehicle and minute: seconds with the engine on and idle, and energy charged, from steps between samples."""
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")
    dt = F.col("ts_ms") - F.lag("ts_ms").over(w)
    df = telemetry.withColumn("dt_ms", F.when((dt > 0) & (dt < most_gap_ms), dt).otherwise(0))
    on = F.coalesce("ignition", F.lit(False))
    idle = on & (F.coalesce("speed_kmh", F.lit(0.0)) < 2.0)
    return df.groupBy("tenant_id", "vehicle_pid", bucket("ts_ms", 60_000).alias("minute_ms")).agg(
        F.sum(F.when(on, F.col("dt_ms")).otherwise(0)).alias("engine_on_ms"),
        F.sum(F.when(idle, F.col("dt_ms")).otherwise(0)).alias("idle_ms"),
        F.sum(F.when(F.col("charge_state") == "CHARGING", F.col("charge_kw") * F.col("dt_ms") / 3_600_000.0).otherwise(0.0)).alias("energy_kwh"),
        F.sum(F.coalesce("speed_kmh", F.lit(0.0)) * F.col("dt_ms") / 3_600_000.0).alias("distance_km"),
    )


def cost_daily(trips: DataFrame, idles: DataFrame, charges: DataFrame) -> DataFrame:
    """Per tenant, vehicle and day: costs by kind, kilometres, cost per kilometre, CO2 and utilisation. Inputs have
    tenant_id, vehicle_pid, start_ms and their measures; days come from start_ms. Three partial sums, one union, one shuffle."""
    measures = ("trip_cost", "idle_cost", "charge_cost", "avoidable_cost", "km", "co2_kg", "drive_s")

    def part(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select("tenant_id", "vehicle_pid", bucket("start_ms", DAY_MS).alias("day_ms"), *[cols.get(m, F.lit(0.0)).cast("double").alias(m) for m in measures])

    rows = part(trips, trip_cost=F.col("cost"), km=F.col("distance_km"), co2_kg=F.col("co2_kg"), drive_s=F.col("duration_s"))
    rows = rows.unionByName(part(idles, idle_cost=F.col("cost"), avoidable_cost=F.col("avoidable_cost"), co2_kg=F.col("co2_kg"))).unionByName(part(charges, charge_cost=F.col("smart_cost")))
    df = rows.groupBy("tenant_id", "vehicle_pid", "day_ms").agg(*[F.sum(m).alias(m) for m in measures])
    total = F.col("trip_cost") + F.col("idle_cost") + F.col("charge_cost")
    return df.withColumn("total_cost", total).withColumn("cost_per_km", F.when(F.col("km") > 0, F.col("total_cost") / F.col("km"))).withColumn("utilisation", F.least(F.lit(1.0), F.col("drive_s") / 86_400.0))


def cost_summary(daily: DataFrame, by: list[str], cost: str = "total_cost", km: str = "km") -> DataFrame:
    return daily.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(cost).alias("cost"), F.sum(km).alias("km"))


def avoidable_daily(episodes: DataFrame, allowed_min: float = 10.0) -> DataFrame:
    """Per vehicle and day: idle minutes beyond the allowance at the day's mean cost per minute."""
    df = episodes.groupBy("vehicle_pid", bucket("start_ms", DAY_MS).alias("day_ms")).agg((F.sum("duration_s") / 60.0).alias("idle_min"), F.sum("cost").alias("cost"))
    extra = F.greatest(F.lit(0.0), F.col("idle_min") - allowed_min)
    return df.withColumn("avoidable_cost", F.when(F.col("idle_min") > 0, extra * (F.col("cost") / F.col("idle_min"))).otherwise(0.0))


def top_idlers(episodes: DataFrame, k: int = 100) -> DataFrame:
    return episodes.groupBy("vehicle_pid").agg(F.sum("duration_s").alias("idle_s"), F.sum("cost").alias("cost")).orderBy(F.col("idle_s").desc(), "vehicle_pid").limit(k)


def fleet_status(live: DataFrame, risk_soc: float = 15.0) -> DataFrame:
    """Per tenant: vehicles, charging, at risk, mean charge, and a histogram of charge in steps of 20."""
    step = F.least(F.lit(4), F.floor(F.col("soc_pct") / 20.0))
    hist = [F.count_if(step == i).alias(f"soc_{20 * i}") for i in range(5)]
    return live.groupBy("tenant_id").agg(F.count("*").alias("vehicles"), F.count_if(F.col("status") == "CHARGING").alias("charging"), F.count_if(F.col("soc_pct") <= risk_soc).alias("at_risk"), F.avg("soc_pct").alias("avg_soc"), *hist)


def utilisation(active: DataFrame, target_hours: float, least_days: int = 7) -> DataFrame:
    """Per vehicle: mean active hours a day against a target, and whether there was a run of least_days days under it.
    active: vehicle_pid, day (integer), hours."""
    w = Window.partitionBy("vehicle_pid").orderBy("day")
    low = active.where(F.col("hours") < target_hours).withColumn("run", F.col("day") - F.row_number().over(w))
    runs = low.groupBy("vehicle_pid", "run").agg(F.count("*").alias("n")).groupBy("vehicle_pid").agg(F.max("n").alias("longest"))
    mean = active.groupBy("vehicle_pid").agg(F.count("*").alias("days"), F.avg("hours").alias("hours"))
    return mean.join(runs, "vehicle_pid", "left").withColumn("longest", F.coalesce("longest", F.lit(0))).withColumn("underused", F.col("longest") >= least_days)


def ledger(df: DataFrame, key: str, id_u64: Column) -> DataFrame:
    """Rows, distinct ids and the exact sum of distinct 64-bit ids per key: equal sums mean nothing was lost."""
    ids = df.select(key, id_u64.alias("id")).groupBy(key, "id").agg(F.count("*").alias("n"))
    return ids.groupBy(key).agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.sum(F.col("id").cast("decimal(38,0)")).alias("id_sum"))


def activity_profile(telemetry: DataFrame, rare: float = 0.05) -> DataFrame:
    """Per vehicle and hour of the week: share of observed days of that weekday with activity, and whether that is rare."""
    t = F.timestamp_millis("ts_ms")
    rows = telemetry.select("vehicle_pid", F.weekday(t).alias("dow"), F.hour(t).alias("hour"), F.to_date(t).alias("day"))
    days = rows.groupBy("vehicle_pid", "dow").agg(F.countDistinct("day").alias("days"))
    hours = rows.groupBy("vehicle_pid", "dow", "hour").agg(F.countDistinct("day").alias("active"))
    return hours.join(days, ["vehicle_pid", "dow"]).withColumn("probability", F.col("active") / F.col("days")).withColumn("rare", F.col("probability") <= rare)


def sketches(df: DataFrame, group: str, item: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    """Per group: approximate distinct count and a Count-Min sketch of the items, both mergeable."""
    return df.groupBy(group).agg(F.approx_count_distinct(item).alias("distinct_items"), F.count_min_sketch(F.col(item), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def sliding(telemetry: DataFrame, width_ms: int = 3_600_000) -> DataFrame:
    """Mean, count and greatest speed over the last hour up to each sample."""
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms").rangeBetween(-width_ms, 0)
    return telemetry.select("vehicle_pid", "ts_ms", "seq", F.count("*").over(w).alias("n"), F.sum("speed_kmh").over(w).alias("speed_sum"), F.max("speed_kmh").over(w).alias("speed_max"))

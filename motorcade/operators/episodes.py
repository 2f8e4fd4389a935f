"""Idle, charging and parking episodes as islands of consecutive samples, in window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorcade.config import CHARGE, FENCE, IDLE, ChargeConfig, FenceConfig, IdleConfig
from motorcade.functions.geo import geohash, haversine
from motorcade.functions.ids import uuid3
from motorcade.operators.safety import cooled


def in_order():
    return Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")


def half_up(x: Column, places: int) -> Column:
    """Rounded half up, as floor(x * 10**places + 0.5)."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def islands(df: DataFrame, inside: Column, name: str = "island") -> DataFrame:
    """Samples with `inside`, the running number of the run they belong to, and the next sample's time."""
    df = df.withColumn("inside", F.coalesce(inside, F.lit(False)))
    change = F.when(F.col("inside") != F.lag("inside").over(in_order()), 1).otherwise(0)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(in_order())).withColumn("next_ms", F.lead("ts_ms").over(in_order())).withColumn("prev_ms", F.lag("ts_ms").over(in_order())).drop("_change")


def idle_condition(speed_kmh: float = IDLE.speed_kmh) -> Column:
    """Engine on (rpm above 0 or ignition), not charging, slower than the limit; nulls count as 0 or off."""
    engine = F.coalesce(F.col("rpm") > 0, F.lit(False)) | F.coalesce("ignition", F.lit(False))
    return engine & ~F.coalesce(F.col("charge_state") == "CHARGING", F.lit(False)) & (F.coalesce("speed_kmh", F.lit(0.0)) < speed_kmh)


def idle_episodes(telemetry: DataFrame, c: IdleConfig = IDLE) -> DataFrame:
    """Idle runs confirmed by a sample at least min_s after the first, and ended by a later sample; the last run of a vehicle stays open."""
    df = islands(telemetry, idle_condition(c.speed_kmh)).where("inside")
    run = df.groupBy("vehicle_pid", "tenant_id", "island").agg(
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.max_by("next_ms", F.struct("ts_ms", "seq")).alias("end_ms"),
        F.min_by("lat_e6", F.struct("ts_ms", "seq")).alias("lat_e6"),
        F.min_by("lon_e6", F.struct("ts_ms", "seq")).alias("lon_e6"),
    )
    whole = lambda x: F.floor(x / 1000).cast("bigint")
    run = run.where(F.col("end_ms").isNotNull() & (whole(F.col("last_ms") - F.col("start_ms")) >= c.min_s))
    run = run.withColumn("duration_s", F.greatest(F.lit(c.min_s).cast("bigint"), whole(F.col("end_ms") - F.col("start_ms"))))
    litres = F.col("duration_s") / 3600.0 * c.litres_per_hour
    extra = F.greatest(F.lit(0.0), F.col("duration_s") / 60.0 - c.allowed_min) * (c.litres_per_hour / 60.0 * c.fuel_price)
    return run.select(
        uuid3(F.concat(F.col("vehicle_pid"), F.lit(":idle:"), F.col("start_ms").cast("string"))).alias("idle_id"),
        "vehicle_pid",
        "tenant_id",
        "start_ms",
        "end_ms",
        "duration_s",
        "lat_e6",
        "lon_e6",
        geohash(F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6, 7).alias("geohash7"),
        half_up(litres, 3).alias("fuel_l"),
        half_up(litres * c.fuel_price, 2).alias("cost"),
        half_up(extra, 2).alias("avoidable_cost"),
        half_up(litres * c.co2_per_litre, 2).alias("co2_kg"),
    )


def charging_sessions(telemetry: DataFrame, c: ChargeConfig = CHARGE) -> DataFrame:
    """Charging runs ended by a sample that doesn't charge: energy of steps shorter than max_gap_ms, costs, and health of
    battery where the charge rose enough. Runs shorter than min_ms are dropped."""
    charging = F.coalesce(F.upper("charge_state") == "CHARGING", F.lit(False)) | F.coalesce(F.col("charge_kw") > c.min_kw, F.lit(False))
    df = islands(telemetry, charging).where("inside")
    at = Window.partitionBy("vehicle_pid", "island").orderBy("ts_ms", "seq")
    kw, soc = F.coalesce("charge_kw", F.lit(c.default_kw)), F.coalesce("soc_pct", F.lit(0.0))
    dt = F.col("ts_ms") - F.lag("ts_ms").over(at)
    counted = (dt > 0) & (dt < c.max_gap_ms)
    df = df.withColumn("kwh", F.when(counted, kw * dt / 3_600_000.0).otherwise(0.0)).withColumn("peak", F.when(counted | dt.isNull(), kw)).withColumn("soc", soc)
    order = F.struct("ts_ms", "seq")
    run = df.groupBy("vehicle_pid", "tenant_id", "island").agg(
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.max_by("next_ms", order).alias("next_ms"),
        F.min_by("soc", order).alias("start_soc"),
        F.max_by("soc", order).alias("end_soc"),
        F.sum("kwh").alias("kwh"),
        F.max("peak").alias("peak_kw"),
    )
    run = run.where("next_ms is not null").withColumn("end_ms", F.when(F.col("last_ms") > F.col("start_ms"), F.col("last_ms")).otherwise(F.col("next_ms")))
    run = run.where(F.col("end_ms") - F.col("start_ms") >= c.min_ms)
    hours = F.greatest(F.lit(0.01), (F.col("end_ms") - F.col("start_ms")) / 3_600_000.0)
    rise = F.col("end_soc") - F.col("start_soc")
    soh = F.when((rise >= c.soh_min_delta) & (F.col("kwh") > 0.5), F.least(F.lit(100.0), F.greatest(F.lit(50.0), F.col("kwh") * c.efficiency / (rise / 100.0 * c.nominal_kwh) * 100.0)))
    return run.select(
        uuid3(F.concat(F.col("vehicle_pid"), F.lit(":charge:"), F.col("start_ms").cast("string"))).alias("session_id"),
        "vehicle_pid",
        "tenant_id",
        "start_ms",
        "end_ms",
        half_up(F.col("start_soc"), 1).alias("start_soc_pct"),
        half_up(F.col("end_soc"), 1).alias("end_soc_pct"),
        half_up(F.col("kwh"), 3).alias("energy_kwh"),
        half_up(F.col("kwh") / hours, 1).alias("avg_power_kw"),
        half_up(F.col("peak_kw"), 1).alias("peak_power_kw"),
        half_up(F.col("kwh") * c.price, 2).alias("baseline_cost"),
        half_up(F.col("kwh") * c.off_peak_price, 2).alias("smart_cost"),
        half_up(F.greatest(F.lit(0.0), F.col("kwh") * (c.price - c.off_peak_price)), 2).alias("cost_saving"),
        half_up(soh, 1).alias("soh_estimate"),
    )


def median_soh(sessions: DataFrame, last: int = 5, least_delta: float = 15.0) -> DataFrame:
    """Median battery health of each vehicle's last qualifying sessions, between 50 and 100."""
    w = Window.partitionBy("vehicle_pid").orderBy(F.col("start_ms").desc())
    rows = sessions.where(F.col("soh_estimate").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    return rows.groupBy("vehicle_pid").agg(F.median("soh_estimate").alias("soh_median"), F.count("*").alias("sessions"))


def range_risk(telemetry: DataFrame, sessions: DataFrame, c: ChargeConfig = CHARGE) -> DataFrame:
    """Low-energy alerts, one per cooldown. Health of battery is that of the last session closed before the sample, else the default."""
    closed = sessions.where("soh_estimate is not null").select("vehicle_pid", F.col("end_ms").alias("ts_ms"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("int").alias("tenant_id"), F.lit(None).cast("double").alias("soc_pct"), F.col("soh_estimate").alias("soh"))
    rows = telemetry.where("soc_pct is not null").select("vehicle_pid", "ts_ms", "seq", "tenant_id", F.col("soc_pct").cast("double"), F.lit(None).cast("double").alias("soh"))
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", F.col("seq").asc_nulls_last())
    df = rows.unionByName(closed).withColumn("soh", F.coalesce(F.last("soh", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(c.default_soh))).where("soc_pct is not null")
    usable = F.col("soc_pct") / 100.0 * c.nominal_kwh * (F.col("soh") / 100.0) - 0.1 * c.nominal_kwh
    df = df.withColumn("usable_kwh", usable).where((F.col("soc_pct") <= c.low_soc) | (F.col("usable_kwh") < c.least_kwh))
    kept = cooled(df.select("vehicle_pid", "tenant_id", "ts_ms", "seq", "soc_pct", "soh", "usable_kwh"), c.cooldown_ms)
    window = F.col("ts_ms") - F.col("ts_ms") % c.cooldown_ms
    return kept.withColumn("severity", F.when(F.col("soc_pct") <= c.critical_soc, "CRITICAL").otherwise("HIGH")).withColumn("alert_key", uuid3(F.concat(F.col("vehicle_pid"), F.lit(":RANGE_RISK:"), window.cast("string"))))


def tow_alerts(telemetry: DataFrame, c: FenceConfig = FENCE) -> DataFrame:
    """Moved more than tow_m from where the ignition went off, within tow_window_ms of that; null ignition counts as off."""
    rows = telemetry.where("lat_e6 is not null and lon_e6 is not null")
    df = islands(rows, ~F.coalesce("ignition", F.lit(False))).where("inside")
    at = Window.partitionBy("vehicle_pid", "island").orderBy("ts_ms", "seq")
    first = lambda x: F.first(x).over(at)
    df = df.withColumn("parked_ms", first("ts_ms")).withColumn("moved_m", haversine(first("lat_e6") / 1e6, first("lon_e6") / 1e6, F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6))
    df = df.where((F.col("moved_m") > c.tow_m) & (F.col("ts_ms") - F.col("parked_ms") <= c.tow_window_ms))
    kept = cooled(df.select("vehicle_pid", "tenant_id", "ts_ms", "seq", "moved_m"), c.tow_cooldown_ms, strict=True)
    return kept.withColumn("alert_key", uuid3(F.concat(F.col("vehicle_pid"), F.lit(":TOW:"), F.floor(F.col("ts_ms") / c.tow_cooldown_ms).cast("string"))))

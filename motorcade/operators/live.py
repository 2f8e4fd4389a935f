"""Live state, map cells, alerts and watch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorcade.functions.codes import dtc_critical
from motorcade.functions.geo import geohash
from motorcade.operators.safety import cooled


def status(driving_kmh: float = 5.0) -> Column:
    """CHARGING, then PARKED (ignition known to be off), then DRIVING, else IDLE; a null ignition is none of the middle two."""
    return (
        F.when(F.upper("charge_state") == "CHARGING", "CHARGING")
        .when(F.col("ignition").eqNullSafe(F.lit(False)), "PARKED")
        .when(F.col("ignition").eqNullSafe(F.lit(True)) & (F.col("speed_kmh") >= driving_kmh), "DRIVING")
        .otherwise("IDLE")
    )


def latest(df: DataFrame, key: str = "vehicle_pid", arrival: str = "seq") -> DataFrame:
    """The row of greatest time of each key; of equal times the one that arrived first. An aggregate with partial
    results per task, so a key's rows never meet in one place."""
    cols = df.columns
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col("ts_ms"), -F.col(arrival))).alias("r"))
    return best.select("r.*")


def live_state(telemetry: DataFrame) -> DataFrame:
    now = latest(telemetry)
    return now.select("tenant_id", "vehicle_pid", "ts_ms", "lat_e6", "lon_e6", "speed_kmh", "heading_deg", "soc_pct", status().alias("status"), F.size(F.coalesce("dtc", F.array())).alias("dtc_count"), geohash(F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6, 6).alias("geohash6"))


def cell_counts(live: DataFrame, precisions: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """Vehicles per tenant and map cell at each precision: a coarse cell is a prefix of a fine one."""
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("precision"), F.substr("geohash6", F.lit(1), F.lit(p)).alias("cell")) for p in precisions]))
    return live.where("geohash6 is not null").select("tenant_id", cells.alias("c")).groupBy("tenant_id", "c.precision", "c.cell").agg(F.count("*").alias("vehicles"))


def cell_changes(telemetry: DataFrame, precision: int = 6) -> DataFrame:
    """Samples at which a vehicle's cell changed, with the cell it left (null at first)."""
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")
    df = telemetry.where("lat_e6 is not null and lon_e6 is not null").withColumn("cell", geohash(F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6, precision))
    df = df.withColumn("left_cell", F.lag("cell").over(w))
    return df.where(~F.col("cell").eqNullSafe(F.col("left_cell"))).select("tenant_id", "vehicle_pid", "ts_ms", "left_cell", "cell")


def offline(live: DataFrame, now_ms: Column | int, interval_s: int = 30) -> DataFrame:
    """Vehicles without a message for three intervals and at least 90 s."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return live.withColumn("silent_ms", now - F.col("ts_ms")).withColumn("offline", F.col("silent_ms") > max(3 * interval_s, 90) * 1000)


def dtc_alerts(telemetry: DataFrame, cooldown_ms: int = 300_000) -> DataFrame:
    """Alerts for critical codes, one per vehicle and cooldown."""
    df = telemetry.withColumn("code", dtc_critical(F.col("dtc"))).where("code is not null").select("vehicle_pid", "tenant_id", "ts_ms", "seq", "code")
    return cooled(df, cooldown_ms)


def watched(telemetry: DataFrame, watchlist: DataFrame, trail: int = 500) -> DataFrame:
    """Last samples of the vehicles on a list."""
    w = Window.partitionBy("vehicle_pid").orderBy(F.col("ts_ms").desc(), F.col("seq").desc())
    return telemetry.join(watchlist, "vehicle_pid", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= trail).drop("_n")


def in_box(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.where(F.col("lat_e6").between(int(south * 1e6), int(north * 1e6)) & F.col("lon_e6").between(int(west * 1e6), int(east * 1e6)))

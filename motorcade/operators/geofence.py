"""Geofence transitions with hysteresis.

Samples meet fences by geohash cell: a fence covers the cells of its bounding box, samples have one cell, and an
equi-join with the distance test as residual gives memberships. A vehicle's state at a fence is set by the last run of
enough samples inside or outside, so transitions follow from windows over the samples inside: a run inside confirms by
its length, one outside by the distance to the next sample inside. Only memberships are ever held, no pairs of samples
and fences that lie apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorcade.config import FENCE, FenceConfig
from motorcade.functions.geo import EARTH_M, cover_bbox, geohash, haversine, in_polygon
from motorcade.functions.ids import uuid3

PRECISION = 5


def covered(fences: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Circle fences (fence_id, type, lat, lon, radius_m) with one row for each cell of their bounding box."""
    dlat = F.degrees(F.col("radius_m") / EARTH_M) * 1.001
    dlon = dlat / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs(F.col("lat")) + dlat)))
    cells = cover_bbox(F.col("lat") - dlat, F.col("lon") - dlon, F.col("lat") + dlat, F.col("lon") + dlon, precision)
    return fences.withColumn("cell", F.explode(F.array_distinct(cells)))


def inside_circles(samples: DataFrame, fences: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Samples and the fences they lie in, with the distance. Spark picks the join by the sides' sizes."""
    s = samples.where("lat_e6 is not null and lon_e6 is not null").withColumn("cell", geohash(F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6, precision))
    f = covered(fences, precision)
    d = haversine(f["lat"], f["lon"], s["lat_e6"] / 1e6, s["lon_e6"] / 1e6)
    return s.join(f, "cell").withColumn("distance_m", d).where("distance_m <= radius_m").drop("cell")


def inside_polygons(samples: DataFrame, polygons: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Samples and polygons (fence_id, ring: array of (lat, lon)) that contain them: cells of the bounding box first, then ray casting."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    p = polygons.withColumns({"s": side(F.array_min, "lat"), "n": side(F.array_max, "lat"), "w": side(F.array_min, "lon"), "e": side(F.array_max, "lon")})
    p = p.withColumn("cell", F.explode(F.array_distinct(cover_bbox(F.col("s"), F.col("w"), F.col("n"), F.col("e"), precision))))
    s = samples.where("lat_e6 is not null and lon_e6 is not null").withColumn("cell", geohash(F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6, precision))
    lat, lon = F.col("lat_e6") / 1e6, F.col("lon_e6") / 1e6
    box = lat.between(F.col("s"), F.col("n")) & lon.between(F.col("w"), F.col("e"))
    return s.join(p, "cell").where(box).where(in_polygon(lat, lon, F.col("ring"))).drop("cell", "s", "n", "w", "e", "ring")


def transitions(telemetry: DataFrame, fences: DataFrame, c: FenceConfig = FENCE, last_only: bool = False) -> DataFrame:
    """ENTER, EXIT and BREACH events, confirmed by c.confirm samples in a row. With last_only, of several fences that
    change at one sample only the one of greatest id is reported."""
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")
    rows = telemetry.where("lat_e6 is not null and lon_e6 is not null").select("vehicle_pid", "tenant_id", "ts_ms", "seq", "lat_e6", "lon_e6")
    # each sample's number, and the sample that confirms an exit if this is the last one inside
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("out", F.lead(F.struct("ts_ms", "seq", "tenant_id"), c.confirm).over(w))
    held = inside_circles(rows, fences).select("vehicle_pid", "fence_id", "type", "n", "out", F.struct("ts_ms", "seq", "tenant_id").alias("at"))
    at_fence = Window.partitionBy("vehicle_pid", "fence_id").orderBy("n")
    held = held.withColumn("begins", F.coalesce(F.col("n") - F.lag("n").over(at_fence) > 1, F.lit(True)))
    held = held.withColumn("first", F.last(F.when(F.col("begins"), F.col("n")), True).over(at_fence))
    away = F.coalesce(F.lead("n").over(at_fence) - F.col("n") > c.confirm, F.lit(True)) & F.col("out").isNotNull()
    entered = F.when(F.col("n") - F.col("first") + 1 == c.confirm, F.struct(F.col("n").alias("n"), F.lit(True).alias("inside"), F.col("at").alias("at")))
    left = F.when(away, F.struct((F.col("n") + c.confirm).alias("n"), F.lit(False).alias("inside"), F.col("out").alias("at")))
    held = held.withColumn("found", F.filter(F.array(entered, left), lambda x: x.isNotNull())).select("vehicle_pid", "fence_id", "type", F.explode("found").alias("x"))
    held = held.select("vehicle_pid", "fence_id", F.col("type").alias("fence_type"), "x.*")
    changed = held.withColumn("was", F.coalesce(F.lag("inside").over(at_fence), F.lit(False))).where("inside != was")
    kind = F.when(~F.col("inside"), "EXIT").when(F.upper("fence_type") == "RESTRICTED", "BREACH").otherwise("ENTER")
    out = changed.select("vehicle_pid", "at.tenant_id", "fence_id", "fence_type", kind.alias("transition"), "at.ts_ms", "at.seq")
    if last_only:
        out = out.groupBy("vehicle_pid", "tenant_id", "ts_ms", "seq").agg(F.max(F.struct("fence_id", "fence_type", "transition")).alias("x")).select("vehicle_pid", "tenant_id", "x.*", "ts_ms", "seq")
    return out.withColumn("event_id", uuid3(F.concat_ws(":", "vehicle_pid", F.col("fence_id").cast("string"), F.col("ts_ms").cast("string"), "transition")))


def metres_to_degrees(metres: float, lat: float) -> tuple[float, float]:
    d = math.degrees(metres / EARTH_M)
    return d, d / max(0.01, math.cos(math.radians(lat)))

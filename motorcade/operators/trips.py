"""Trips of vehicles from their ordered samples, harmless to rerun: trip ids follow from vehicle and start time.

A vehicle is parked, about to leave, under way, or halted. Each sample is first put into signals (fast, slow, away,
waited, silent), the phase and the signals say which move is made, and the moves say what changes:

| phase | move | when | next |
|---|---|---|---|
| parked | leave | fast and 30 m from the anchor | leaving |
| leaving | stay | slow | parked |
| leaving | depart | otherwise, after 10 s or 50 m from the anchor | under way |
| under way | halt | slow | halted |
| under way | cut | silent for 15 minutes before | parked, TRUNCATED |
| halted | resume | fast | under way |
| halted | arrive | otherwise, ignition not on or 5 minutes | parked, COMPLETED |

A parked vehicle within 30 m of its anchor drags the anchor along by a tenth of the way. A null speed is 0; an anchor or
last place at latitude 0 counts as unknown.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorcade.config import TRIP, TripConfig
from motorcade.functions.geo import geohash, metres
from motorcade.functions.ids import uuid3
from motorcade.operators.lockstep import Arrays, run

PARKED, LEAVING, UNDER_WAY, HALTED = range(4)
COLUMNS = ("ts_ms", "lat_e6", "lon_e6", "speed_kmh", "ignition", "odo_km")


def apart(lat1, lon1, lat2, lon2):
    """Metres between two places in millionths of degrees; NaN where one is unknown."""
    known = (lat1 != 0) & (lat2 == lat2)
    return np.where(known, metres(lat1 / 1e6, lon1 / 1e6, lat2 / 1e6, lon2 / 1e6), np.nan)


class TripMachine:
    columns = COLUMNS
    schema = "start_ms bigint, end_ms bigint, start_lat_e6 int, start_lon_e6 int, end_lat_e6 int, end_lon_e6 int, km double, idle_s int, cut boolean"
    start = {"phase": PARKED, "new": True, "anchor_lat": 0.0, "anchor_lon": 0.0, "lat": 0.0, "lon": 0.0, "odo": np.nan, "seen": 0}
    start |= {"since": 0, "begun": 0, "from_lat": 0.0, "from_lon": 0.0, "km": 0.0, "idle_s": 0}

    def __init__(self, config: TripConfig = TRIP):
        self.config = config

    def step(self, state: Arrays, row: Arrays) -> tuple[Arrays, Arrays]:
        c, s, now, phase = self.config, dict(state), row["ts_ms"], state["phase"]
        known = ~np.isnan(row["lat_e6"].astype(float)) & ~np.isnan(row["lon_e6"].astype(float))
        lat, lon = np.where(known, row["lat_e6"], np.nan), np.where(known, row["lon_e6"], np.nan)
        for place in ("anchor_lat", "lat"):
            s[place] = np.where(s["new"] & known, lat, s[place])
        for place in ("anchor_lon", "lon"):
            s[place] = np.where(s["new"] & known, lon, s[place])
        s["seen"], s["odo"] = np.where(s["new"], now, s["seen"]), np.where(s["new"], row["odo_km"], s["odo"])

        # signals
        speed = np.nan_to_num(row["speed_kmh"].astype(float))
        fast, slow = speed >= c.moving_kmh, speed < c.stopped_kmh
        away = np.nan_to_num(apart(s["anchor_lat"], s["anchor_lon"], lat, lon))
        waited, silent = (now - s["since"]) // 1000, now - s["seen"]

        # moves
        leave = (phase == PARKED) & fast & (away >= c.anchor_m)
        drag = (phase == PARKED) & ~leave & known & (away < c.anchor_m)
        stay = (phase == LEAVING) & slow
        depart = (phase == LEAVING) & ~slow & ((waited >= c.confirm_s) | (away >= c.start_m))
        halt = (phase == UNDER_WAY) & slow
        cut = (phase == UNDER_WAY) & (silent >= c.gap_ms)
        resume = (phase == HALTED) & fast
        arrive = (phase == HALTED) & ~fast & ((row["ignition"] != 1) | (waited >= c.stationary_s))
        done = cut | arrive

        # what they change
        driven = row["odo_km"] - s["odo"]
        hop = apart(s["lat"], s["lon"], lat, lon)
        step = np.where((driven > 0) & (driven < 5), driven, np.where((hop > 2) & (hop < 2000), hop / 1000, 0.0))
        s["km"] = s["km"] + np.where((phase == UNDER_WAY) | resume, step, 0.0)
        s["idle_s"] = s["idle_s"] + np.where(phase == HALTED, silent // 1000, 0)
        end_lat, end_lon = np.where(known, lat, s["lat"]), np.where(known, lon, s["lon"])
        out = {"when": done, "start_ms": s["begun"], "end_ms": now, "start_lat_e6": s["from_lat"].astype(int), "start_lon_e6": s["from_lon"].astype(int)}
        out |= {"end_lat_e6": end_lat.astype(int), "end_lon_e6": end_lon.astype(int), "km": s["km"], "idle_s": s["idle_s"], "cut": cut}

        s["begun"] = np.where(depart, s["since"], s["begun"])
        s["from_lat"] = np.where(depart, np.where(known, lat, s["anchor_lat"]), s["from_lat"])
        s["from_lon"] = np.where(depart, np.where(known, lon, s["anchor_lon"]), s["from_lon"])
        s["km"], s["idle_s"] = np.where(depart | done, 0.0, s["km"]), np.where(depart | done, 0, s["idle_s"])
        s["since"] = np.where(leave | halt, now, s["since"])
        for place, to in (("anchor_lat", lat), ("anchor_lon", lon)):
            dragged = np.trunc(s[place] * 0.9 + np.where(known, to, 0.0) * 0.1)
            s[place] = np.where(done & known, to, np.where(drag, dragged, s[place]))
        s["phase"] = np.select([done | stay, leave, depart | resume, halt], [PARKED, LEAVING, UNDER_WAY, HALTED], phase)
        s["new"], s["seen"], s["lat"], s["lon"] = np.zeros_like(done), now, end_lat, end_lon
        s["odo"] = np.where(np.isnan(row["odo_km"]), s["odo"], row["odo_km"])
        return s, out


def prepared(telemetry: DataFrame) -> DataFrame:
    """Samples with an odometer column, null where there is none."""
    return telemetry if "odo_km" in telemetry.columns else telemetry.withColumn("odo_km", F.lit(None).cast("double"))


def finished(closed: DataFrame, c: TripConfig = TRIP) -> DataFrame:
    """Trips (see schemas.TRIP) from what the machine yields."""
    half_up = lambda x, places: F.floor(x * 10.0**places + 0.5) / 10.0**places
    cell = lambda end: geohash(F.col(f"{end}_lat_e6") / 1e6, F.col(f"{end}_lon_e6") / 1e6, 7).alias(f"{end}_geohash7")
    litres = F.col("km") * c.litres_per_km
    return closed.select(
        uuid3(F.concat_ws(":", "vehicle_pid", F.col("start_ms").cast("string"))).alias("trip_id"),
        F.col("vehicle_pid").cast("string").alias("vehicle_pid"),
        "tenant_id",
        "start_ms",
        "end_ms",
        "start_lat_e6",
        "start_lon_e6",
        cell("start"),
        "end_lat_e6",
        "end_lon_e6",
        cell("end"),
        half_up(F.col("km"), 3).alias("distance_km"),
        F.greatest(F.lit(1), F.floor((F.col("end_ms") - F.col("start_ms")) / 1000)).cast("int").alias("duration_s"),
        "idle_s",
        litres.alias("fuel_l"),
        half_up(litres * c.fuel_price, 2).alias("cost"),
        half_up(litres * c.co2_per_litre, 2).alias("co2_kg"),
        F.when(F.col("cut"), "TRUNCATED").otherwise("COMPLETED").alias("status"),
    )


def trips(telemetry: DataFrame, config: TripConfig = TRIP) -> DataFrame:
    """Closed trips of ordered samples."""
    return finished(run(prepared(telemetry), "vehicle_pid", ["ts_ms", "seq"], TripMachine(config), ["vehicle_pid", "tenant_id"]), config)

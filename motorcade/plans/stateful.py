"""Queries of stateful operators, algorithms, sharing, generators and the request surface."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from motorcade.config import CLOCK_SKEW
from motorcade.functions.geo import geohash
from motorcade.operators import algorithms, episodes, geofence, live, lockstep, order, paging, rollups, safety, sharing
from motorcade.operators.trips import trips
from motorcade.plans.base import ORACLE, query
from motorcade.plans.relational import CHARGE, DELTAS, FENCE_SQL, IDLE, ISLANDS, LATEST, LIVE, STATUS, fences
from motorcade.plans.telemetry import T0_MS, TELEMETRY, geohash_sql, haversine_sql, r, rc, table, telemetry, uuid3_sql

LAT, LON = "lat_e6 / 1e6", "lon_e6 / 1e6"
#: Arrival order with deterministic delays: samples come up to 30 s after they were taken.
ARRIVAL = "ts_ms + (event_id * 7919 % 31) * 1000"


def arriving(spark, sf):
    """Samples in arrival order, every 20th twice."""
    t = telemetry(spark, sf).withColumn("arrival", F.expr(ARRIVAL)).withColumn("copy", F.lit(0))
    return t.unionByName(t.where("event_id % 20 = 0").withColumn("arrival", F.col("arrival") + 1).withColumn("copy", F.lit(1)))


def cooldown_sql(rows: str, cooldown: int, strict: bool = False) -> str:
    """DuckDB: rows (vehicle_pid, ts_ms, seq) kept by a cooldown, one kept row after the other: the next is the first row far enough on."""
    far = ">" if strict else ">="
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS rn FROM {rows}),
nxt AS (SELECT a.vehicle_pid, a.rn, min(b.rn) AS nx FROM num a LEFT JOIN num b ON a.vehicle_pid = b.vehicle_pid AND b.ts_ms - a.ts_ms {far} {cooldown} AND b.rn > a.rn GROUP BY 1, 2),
kept AS (SELECT vehicle_pid, rn, nx FROM nxt WHERE rn = 1 UNION ALL SELECT n.vehicle_pid, n.rn, n.nx FROM kept k JOIN nxt n ON n.vehicle_pid = k.vehicle_pid AND n.rn = k.nx),
cooled AS (SELECT num.* FROM num JOIN kept USING (vehicle_pid, rn))"""


def recursive(name: str, sql: str) -> None:
    ORACLE[name] = f"WITH RECURSIVE {TELEMETRY}, {sql}"


# streaming operators -----------------------------------------------------------------------------


@query("st_dedupe_tier1", f""", a AS (SELECT vehicle_pid, seq, {ARRIVAL} AS arrival FROM t UNION ALL SELECT vehicle_pid, seq, {ARRIVAL} + 1 FROM t WHERE event_id % 20 = 0),
o AS (SELECT *, max(seq) OVER (PARTITION BY vehicle_pid ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - seq AS behind, row_number() OVER (PARTITION BY vehicle_pid, seq ORDER BY arrival) AS times FROM a)
SELECT vehicle_pid, seq, arrival, CASE WHEN behind >= 4096 THEN 'OUT_OF_WINDOW' WHEN times > 1 THEN 'DUPLICATE' ELSE 'NEW' END AS verdict FROM o""")
def st_dedupe_tier1(spark, sf):
    return order.judged(arriving(spark, sf), "arrival")


@query("st_dedupe_tier2", f"SELECT vehicle_pid, event_id, {ARRIVAL} AS arrival FROM t")
def st_dedupe_tier2(spark, sf):
    return order.first_arrivals(arriving(spark, sf).select("vehicle_pid", "event_id", "arrival"), ["vehicle_pid", "event_id"], "arrival")


@query("st_bloom_rotating", "SELECT tenant_id, count(*) AS copies, count(*) AS found FROM t WHERE event_id % 20 = 0 GROUP BY 1")
def st_bloom_rotating(spark, sf):
    """Copies that the filters of a tenant's last two ten-minute rotations know; tests measure false positives."""
    seen = order.bloom_seen(arriving(spark, sf).select("tenant_id", "event_id", "arrival", "copy"), ["tenant_id"], "event_id", "arrival", 600_000, 20_000, 0.001)
    return seen.where("copy = 1").groupBy("tenant_id").agg(F.count("*").alias("copies"), F.count_if("seen").alias("found"))


def reordered(spark, sf):
    return order.reordered(arriving(spark, sf).where("copy = 0"), "arrival")


@query("st_reorder")
def st_reorder(spark, sf):
    return reordered(spark, sf)


@query("st_silent_flush")
def st_silent_flush(spark, sf):
    """What is left in a vehicle's buffer when it falls silent."""
    r = reordered(spark, sf)
    top = r.groupBy("vehicle_pid").agg(F.max("ts_ms").alias("top"))
    return r.join(top, "vehicle_pid").where("route = 'clean' and ts_ms > top - 10000").select("vehicle_pid", "ts_ms", "seq", "position")


@query("st_skew_flag", f"SELECT seq, CASE WHEN k < 5 THEN {CLOCK_SKEW} ELSE 0 END AS skewed FROM t")
def st_skew_flag(spark, sf):
    """Samples taken five minutes after they arrived, by the vehicle's clock."""
    t = telemetry(spark, sf).withColumn("now", F.col("ts_ms") - F.when(F.col("k") < 5, 300_001).otherwise(0))
    return order.reordered(t, "now").select("seq", F.col("quality").bitwiseAND(CLOCK_SKEW).alias("skewed"))


@query("st_late_route", f", a AS (SELECT *, {ARRIVAL} AS arrival FROM t), w AS (SELECT event_id, ts_ms, max(ts_ms) OVER (PARTITION BY vehicle_pid ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10000 AS mark FROM a) SELECT event_id, coalesce(ts_ms <= mark, false) AS behind FROM w")
def st_late_route(spark, sf):
    return order.late_flags(arriving(spark, sf).where("copy = 0"), "arrival").select("event_id", "behind")


@query("st_live_state", f", {LIVE} SELECT vehicle_pid, ts_ms, status, gh6, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS dtc_count FROM lv")
def st_live_state(spark, sf):
    return live.live_state(telemetry(spark, sf)).select("vehicle_pid", "ts_ms", "status", F.col("geohash6").alias("gh6"), "dtc_count")


@query("st_cell_transition", f", g AS (SELECT *, {geohash_sql(LAT, LON, 6)} AS cell FROM t), h AS (SELECT *, lag(cell) OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS left_cell FROM g) SELECT vehicle_pid, ts_ms, left_cell, cell FROM h WHERE left_cell IS DISTINCT FROM cell")
def st_cell_transition(spark, sf):
    return live.cell_changes(telemetry(spark, sf)).drop("tenant_id")


@query("st_offline", f", {LATEST} SELECT vehicle_pid, {T0_MS + 4_320_000} - ts_ms AS silent_ms, {T0_MS + 4_320_000} - ts_ms > 90000 AS offline FROM l")
def st_offline(spark, sf):
    return live.offline(live.live_state(telemetry(spark, sf)), T0_MS + 4_320_000).select("vehicle_pid", "silent_ms", "offline")


@query("st_alert_dtc")
def st_alert_dtc(spark, sf):
    return live.dtc_alerts(telemetry(spark, sf)).select("vehicle_pid", "ts_ms", "code")


recursive("st_alert_dtc", "x AS (SELECT vehicle_pid, ts_ms, seq, code FROM t WHERE substr(code, 1, 3) IN ('P03', 'P02', 'C00')), " + cooldown_sql("x", 300_000) + " SELECT vehicle_pid, ts_ms, code FROM cooled")


@query("st_cooldown")
def st_cooldown(spark, sf):
    return safety.cooled(telemetry(spark, sf).where("k < 30").select("vehicle_pid", "ts_ms", "seq"), 300_000, strict=True)


recursive("st_cooldown", "x AS (SELECT vehicle_pid, ts_ms, seq FROM t WHERE k < 30), " + cooldown_sql("x", 300_000, True) + " SELECT vehicle_pid, ts_ms, seq FROM cooled")


@query("st_safety")
def st_safety(spark, sf):
    s = safety.safety_events(telemetry(spark, sf))
    return s.select("event_id", "vehicle_pid", "ts_ms", "event_type", rc(F.col("severity")).alias("severity"), rc(F.col("weight")).alias("weight"))


recursive("st_safety", f"{DELTAS}, " + cooldown_sql("c", 5000) + f""" SELECT {uuid3_sql("vehicle_pid || ':' || ts_ms || ':' || event")} AS event_id, vehicle_pid, ts_ms, event AS event_type,
{r("CASE event WHEN 'HARSH_CORNER' THEN rate WHEN 'OVERSPEED' THEN speed_kmh - 100 ELSE abs(accel) END")} AS severity, {r("CASE event WHEN 'HARSH_BRAKE' THEN 3.0 WHEN 'OVERSPEED' THEN 1.0 + (speed_kmh - 100) / 10.0 ELSE 2.0 END")} AS weight FROM cooled""")


@query("st_safety_py", ", " + ISLANDS.format(cond="speed_kmh > 55") + f", o AS (SELECT vehicle_pid, min(ts_ms) AS start_ms, max(next_ms) AS end_ms, bool_or(next_ms IS NULL) AS open, max(speed_kmh - 50) AS over_kmh FROM i WHERE inside GROUP BY vehicle_pid, island) SELECT vehicle_pid, start_ms, end_ms, {r('over_kmh')} AS over_kmh FROM o WHERE NOT open AND (end_ms - start_ms) / 1000.0 >= 10")
def st_safety_py(spark, sf):
    o = safety.overspeed_episodes(telemetry(spark, sf), F.lit(50.0))
    return o.select("vehicle_pid", "start_ms", "end_ms", rc(F.col("over_kmh")).alias("over_kmh"))


AT = T0_MS + 4_400_000


def scores(spark, sf):
    t = telemetry(spark, sf)
    e = safety.candidates(t).select(F.col("vehicle_pid").alias("driver"), "event_type", "weight", "ts_ms")
    d = t.select(F.col("vehicle_pid").alias("driver"), (F.col("k") / 10.0).alias("km"), "ts_ms")
    return safety.driver_scores(e, d, AT)


SCORES = f"""{DELTAS}, dw AS (SELECT vehicle_pid AS driver, event, sum(CASE event WHEN 'HARSH_BRAKE' THEN 3.0 WHEN 'OVERSPEED' THEN 1.0 + (speed_kmh - 100) / 10.0 ELSE 2.0 END * pow(2.0, -({AT} - ts_ms) / 1209600000.0)) AS w FROM c GROUP BY 1, 2),
dt AS (SELECT driver, sum(w) AS w, arg_max(event, (w, event)) AS top FROM dw GROUP BY 1), dk AS (SELECT vehicle_pid AS driver, sum(k / 10.0 * pow(2.0, -({AT} - ts_ms) / 1209600000.0)) AS km FROM t GROUP BY 1),
ds AS (SELECT driver, km, coalesce(w, 0) AS w, top, CASE WHEN km >= 10 THEN least(100.0, greatest(0.0, 100 * exp(-(coalesce(w, 0) / (km / 100.0)) / 8.0))) ELSE 100.0 END AS score FROM dk LEFT JOIN dt USING (driver))"""


@query("st_score_decay", f", {SCORES} SELECT driver, {r('score', 4)} AS score, km >= 10 AND score < 60 AS risky FROM ds")
def st_score_decay(spark, sf):
    return scores(spark, sf).select("driver", rc(F.col("score"), 4).alias("score"), "risky")


@query("coach_top_risk", f", {SCORES} SELECT driver, coalesce(top, 'NONE') AS top_risk FROM ds")
def coach_top_risk(spark, sf):
    return scores(spark, sf).select("driver", F.coalesce("top_risk", F.lit("NONE")).alias("top_risk"))


@query("st_range_risk")
def st_range_risk(spark, sf):
    t = telemetry(spark, sf)
    return episodes.range_risk(t, episodes.charging_sessions(t)).select("vehicle_pid", "ts_ms", "severity", rc(F.col("usable_kwh")).alias("usable_kwh"))


recursive("st_range_risk", f"""{CHARGE}, tm AS (SELECT vehicle_pid, ts_ms, seq, soc_pct, NULL::DOUBLE AS soh FROM t UNION ALL SELECT vehicle_pid, end_ms, NULL, NULL, soh_estimate FROM se WHERE soh_estimate IS NOT NULL),
th AS (SELECT *, coalesce(last_value(soh IGNORE NULLS) OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 95.0) AS h FROM tm),
x AS (SELECT vehicle_pid, ts_ms, seq, soc_pct, soc_pct / 100.0 * 60.0 * (h / 100.0) - 6.0 AS usable FROM th WHERE soc_pct IS NOT NULL AND (soc_pct <= 15 OR soc_pct / 100.0 * 60.0 * (h / 100.0) - 6.0 < 4)),
{cooldown_sql('x', 300_000)} SELECT vehicle_pid, ts_ms, CASE WHEN soc_pct <= 8 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, {r('usable')} AS usable_kwh FROM cooled""")


@query("st_tow")
def st_tow(spark, sf):
    return episodes.tow_alerts(parked(telemetry(spark, sf))).select("vehicle_pid", "ts_ms", rc(F.col("moved_m"), 1).alias("moved_m"))


def parked(t):
    """Half the samples with the ignition off, so that parked vehicles move."""
    return t.withColumn("ignition", F.col("k") % 2 == 0)


TOW = ISLANDS.format(cond="k % 2 <> 0") + f""", fp AS (SELECT *, first(ts_ms) OVER w AS p_ms, first(lat_e6) OVER w AS p_lat, first(lon_e6) OVER w AS p_lon FROM i WHERE inside WINDOW w AS (PARTITION BY vehicle_pid, island ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT * FROM (SELECT vehicle_pid, ts_ms, seq, p_ms, {haversine_sql('p_lat / 1e6', 'p_lon / 1e6', LAT, LON)} AS moved FROM fp) WHERE moved > 300 AND ts_ms - p_ms <= 60000)"""
recursive("st_tow", f"{TOW}, {cooldown_sql('x', 300_000, True)} SELECT vehicle_pid, ts_ms, {r('moved', 1)} AS moved_m FROM cooled")


@query("st_geofence")
def st_geofence(spark, sf):
    return geofence.transitions(telemetry(spark, sf), fences(spark)).select("vehicle_pid", "fence_id", "transition", "ts_ms")


def _hysteresis_sql(confirm: int = 2) -> str:
    """Inside turns over when `confirm` samples in a row differ from it. A state is set by the last run of that many equal
    samples, so it follows from windows: the last sample whose predecessors agree with it gives the state."""
    return f"""{FENCE_SQL}, m AS (SELECT t.vehicle_pid, ts_ms, seq, fence_id, type, CASE WHEN {haversine_sql('lat', 'lon', LAT, LON)} <= radius_m THEN 1 ELSE 0 END AS now FROM t, f),
p AS (SELECT *, coalesce(lag(now) OVER w, 0) AS before, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY vehicle_pid, fence_id ORDER BY ts_ms, seq)),
q AS (SELECT *, CASE WHEN now = before AND (rn > 1) THEN now END AS firm FROM p),
s AS (SELECT *, coalesce(last_value(firm IGNORE NULLS) OVER (PARTITION BY vehicle_pid, fence_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM q),
u AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY vehicle_pid, fence_id ORDER BY ts_ms, seq), 0) AS was FROM s)
SELECT vehicle_pid, CAST(fence_id AS INTEGER) AS fence_id, CASE WHEN state = 0 THEN 'EXIT' WHEN type = 'RESTRICTED' THEN 'BREACH' ELSE 'ENTER' END AS transition, ts_ms FROM u WHERE state <> was"""


recursive("st_geofence", _hysteresis_sql())


@query("w_hysteresis_n")
def w_hysteresis_n(spark, sf):
    return geofence.transitions(telemetry(spark, sf), fences(spark)).groupBy("fence_id", "transition").agg(F.count("*").alias("n"))


recursive("w_hysteresis_n", "z AS (WITH " + _hysteresis_sql().replace("SELECT vehicle_pid, CAST(fence_id AS INTEGER)", "SELECT vehicle_pid, CAST(fence_id AS INTEGER)", 1) + ") SELECT fence_id, transition, count(*) AS n FROM z GROUP BY 1, 2")


@query("st_gps_filter")
def st_gps_filter(spark, sf):
    return order.gps_filtered(telemetry(spark, sf))


@query("st_watchlist", "SELECT vehicle_pid, event_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms DESC, seq DESC) AS n FROM t WHERE vehicle_pid IN ('3', '5', '8')) WHERE n <= 20")
def st_watchlist(spark, sf):
    w = spark.createDataFrame([("3",), ("5",), ("8",)], "vehicle_pid string")
    return live.watched(telemetry(spark, sf), w, 20).select("vehicle_pid", "event_id")


@query("st_trip_fsm")
def st_trip_fsm(spark, sf):
    return trips(telemetry(spark, sf)).withColumn("fuel_l", rc(F.col("fuel_l")))


@query("st_trip_fsm_py")
def st_trip_fsm_py(spark, sf):
    """The three-phase variant."""
    from motorcade.operators.phases import phase_trips

    return phase_trips(telemetry(spark, sf)).withColumns({"distance_km": rc(F.col("distance_km"), 6), "idle_s": rc(F.col("idle_s"))})


@query("st_idle_py")
def st_idle_py(spark, sf):
    """The variant with costs by powertrain and close reasons; samples may lie ten minutes apart here."""
    from motorcade.operators.phases import phase_idles

    e = phase_idles(telemetry(spark, sf), gap_s=600)
    return e.withColumns({c: rc(F.col(c), 10) for c in ("duration_s", "fuel_l", "energy_kwh", "cost", "co2_kg")})


# algorithms --------------------------------------------------------------------------------------


@query("dp_viterbi")
def dp_viterbi(spark, sf):
    """Tests compare with all labellings of short histories."""
    return algorithms.labelled(telemetry(spark, sf))


def requests(spark, sf):
    c = table(spark, sf, "customer")
    need = F.abs("c_acctbal") / 400.0
    e0 = F.lit(15.0)
    return c.select(F.col("c_nationkey").cast("bigint").alias("depot_id"), F.col("c_custkey").cast("string").alias("request_id"), e0.alias("e0_kwh"), F.least(F.lit(55.0), e0 + need).alias("target_kwh"), F.lit(60.0).alias("max_kwh"), F.lit(22.0).alias("charger_kw"), F.lit(11.0).alias("vehicle_kw"), (8 + F.col("c_custkey") % 24).cast("int").alias("slots"))


@query("dp_charging")
def dp_charging(spark, sf):
    """Tests compare with all schedules of small cases."""
    return algorithms.charging_plans(requests(spark, sf).withColumn("prices", algorithms.price_slots(24)))


@query("dp_baseline")
def dp_baseline(spark, sf):
    """What charging at once costs, to 4 places."""
    return dp_charging(spark, sf).groupBy("request_id").agg(F.max("baseline").alias("baseline"))


@query("alloc_depot")
def alloc_depot(spark, sf):
    prices = [0.12 if i % 8 < 5 else 0.28 for i in range(32)]
    return algorithms.allocate_depots(requests(spark, sf), 300.0, prices)


@query("plan_ev_api")
def plan_ev_api(spark, sf):
    """Tests compare with all schedules of small cases."""
    one = spark.range(1).select(F.lit("r").alias("request_id"), F.lit(15.0).alias("e0_kwh"), F.lit(48.0).alias("target_kwh"), F.lit(60.0).alias("max_kwh"), F.lit(22.0).alias("charger_kw"), F.lit(11.0).alias("vehicle_kw"), algorithms.price_slots(48).alias("prices"))
    return algorithms.charging_plans(one).drop("request_id")


@query("plan_depot_api")
def plan_depot_api(spark, sf):
    return alloc_depot(spark, sf).groupBy("depot_id", "slot").agg(F.sum("kwh").alias("kwh"))


@query("q_ev_plan")
def q_ev_plan(spark, sf):
    return dp_charging(spark, sf).where("request_id = '1'")


@query("q_depot_plan")
def q_depot_plan(spark, sf):
    return plan_depot_api(spark, sf).groupBy("depot_id").agg(F.sum("kwh").alias("total_kwh"), (F.max("kwh") / 0.92 / 0.25).alias("peak_kw"))


GRID = 12


def grid(spark):
    nodes, edges = algorithms.grid_graph(GRID)
    n = spark.createDataFrame(nodes, "node int, lat double, lon double")
    e = spark.createDataFrame(edges, "src int, dst int, km double, kmh double")
    return n, e.withColumn("kwh", algorithms.edge_energy(F.col("km"), F.col("kmh")))


def _grid_sql() -> str:
    nodes, edges = algorithms.grid_graph(GRID)
    return "e AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {km!r}::DOUBLE, {v!r}::DOUBLE)" for a, b, km, v in edges) + ") x(src, dst, km, kmh))"


@query("graph_energy", f"WITH {_grid_sql()} SELECT src, dst, {r('km * 1.5 * (0.15 + 0.00003 * (kmh - 50) * (kmh - 50))', 6)} AS kwh FROM e", telemetry=False)
def graph_energy(spark, sf):
    _, e = grid(spark)
    return e.select("src", "dst", rc(algorithms.edge_energy(F.col("km"), F.col("kmh"), "VAN"), 6).alias("kwh"))


def _relaxed_sql(sources: str, reverse: bool) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    rounds = ["d0 AS (" + sources + ")"]
    for i in range(1, 2 * GRID + 6):
        rounds.append(f"d{i} AS (SELECT node, min(dist) AS dist FROM (SELECT node, dist FROM d{i - 1} UNION ALL SELECT {b} AS node, dist + kwh AS dist FROM d{i - 1} JOIN w ON w.{a} = d{i - 1}.node) GROUP BY 1)")
    return f"WITH {_grid_sql()}, w AS (SELECT src, dst, km * (0.15 + 0.00003 * (kmh - 50) * (kmh - 50)) AS kwh FROM e), " + ", ".join(rounds) + f" SELECT CAST(node AS INTEGER) AS node, {r('dist', 6)} AS dist FROM d{2 * GRID + 5}"


@query("graph_multisource", _relaxed_sql("SELECT 0 AS node, 0.0::DOUBLE AS dist UNION ALL SELECT 77, 0.0", True), telemetry=False)
def graph_multisource(spark, sf):
    from motorcade.checkpoints import ensure

    ensure(spark)
    _, e = grid(spark)
    d = algorithms.relaxed(e, spark.createDataFrame([(0,), (77,)], "node int"), 60)
    return d.select("node", rc(F.col("dist"), 6).alias("dist"))


def searched(spark, fn, schema: str):
    """Run a search on the grid, whose adjacency is bounded by its size, in one task per source."""
    nodes, edges = algorithms.grid_graph(GRID)

    def run(batches):
        import pandas as pd

        g = algorithms.Graph(nodes, edges)
        for pdf in batches:
            yield pd.DataFrame([row for s in pdf["src"] for row in fn(g, int(s))], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(0, GRID * GRID, 40).select(F.col("id").cast("int").alias("src")).mapInPandas(run, schema)


@query("graph_dijkstra", _relaxed_sql("SELECT 0 AS node, 0.0::DOUBLE AS dist", False), telemetry=False)
def graph_dijkstra(spark, sf):
    def fn(g, s):
        return [(n, d) for n, d in g.search([s])[0].items()] if s == 0 else []

    return searched(spark, fn, "node int, dist double").withColumn("dist", rc(F.col("dist"), 6))


@query("graph_astar")
def graph_astar(spark, sf):
    """The way to the last node, as its nodes in order."""
    found = searched(spark, lambda g, s: [(s, *g.path(s, GRID * GRID - 1))], "src int, cost double, path array<int>")
    return found.select("src", rc(F.col("cost"), 6).alias("cost"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("graph_reachable")
def graph_reachable(spark, sf):
    return searched(spark, lambda g, s: [(s, c, d) for c, d in g.reachable(s, 2.5, [0, 30, 77, 100, 143])], "src int, charger int, kwh double").withColumn("kwh", rc(F.col("kwh"), 6))


@query("graph_snap")
def graph_snap(spark, sf):
    n, _ = grid(spark)
    points = telemetry(spark, sf).select(F.col("event_id").alias("point_id"), F.expr(LAT).alias("lat"), (F.expr(LON) - 0.2).alias("lon"))
    return algorithms.snapped(points, n).withColumn("distance_m", rc(F.col("distance_m"), 3))


@query("q_nearest_charger")
def q_nearest_charger(spark, sf):
    return graph_reachable(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("kwh", "charger"))).where("rank <= 3")


# sharing -----------------------------------------------------------------------------------------


def hourly_cells(spark, sf):
    t = telemetry(spark, sf)
    return t.select("vehicle_pid", geohash(F.expr(LAT), F.expr(LON), 6).alias("geohash"), F.floor(F.col("ts_ms") / 600_000).alias("hour"))


ANON = f"h AS (SELECT vehicle_pid, substr({geohash_sql(LAT, LON, 6)}, 1, 4) AS cell, ts_ms // 600000 AS hour, count(*) AS n FROM t GROUP BY 1, 2, 3)"


@query("agg_k_anonymity", f", {ANON} SELECT cell, hour, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2 HAVING count(*) >= 10 AND max(n) <= 0.5 * sum(n)")
def agg_k_anonymity(spark, sf):
    c = hourly_cells(spark, sf).select("vehicle_pid", F.substr("geohash", F.lit(1), F.lit(4)).alias("cell"), "hour").withColumn("n", F.lit(1))
    return sharing.anonymous(c, ["cell", "hour"], "vehicle_pid", "n")


@query("agg_contribution_bound", f", {ANON} SELECT vehicle_pid, least(5, count(*)) AS cells FROM h GROUP BY 1")
def agg_contribution_bound(spark, sf):
    c = hourly_cells(spark, sf).select("vehicle_pid", F.substr("geohash", F.lit(1), F.lit(4)).alias("cell"), "hour").distinct()
    return sharing.bounded(c, "vehicle_pid", 5, ["cell", "hour"]).groupBy("vehicle_pid").agg(F.count("*").alias("cells"))


SHARE = f"h AS (SELECT DISTINCT vehicle_pid, substr({geohash_sql(LAT, LON, 6)}, 1, 5) AS cell, ts_ms // 600000 AS hour FROM t) SELECT cell, hour, count(*) AS vehicles FROM h GROUP BY 1, 2 HAVING count(*) >= 5"


@query("p_share_query", f", {SHARE}")
def p_share_query(spark, sf):
    return sharing.shared_cells(hourly_cells(spark, sf), "MOBILITY_FLOW", 5, 0.2, "secret").select("cell", "hour", "vehicles")


@query("q_share_data", f", {SHARE}")
def q_share_data(spark, sf):
    return sharing.shared_cells(hourly_cells(spark, sf), "TRAFFIC_DENSITY", 5, 0.2, "secret").where("noisy >= 0").select("cell", "hour", "vehicles")


@query("p_budget_ledger", f", q AS (SELECT tenant_id AS agreement, ts_ms // 86400000 AS day, ts_ms, seq, 0.2 AS e FROM t WHERE k < 5) SELECT agreement, count(*) AS granted FROM (SELECT *, row_number() OVER (PARTITION BY agreement, day ORDER BY ts_ms, seq) AS n FROM q) WHERE n <= 50 GROUP BY 1")
def p_budget_ledger(spark, sf):
    q = telemetry(spark, sf).where("k < 5").select(F.col("tenant_id").alias("agreement"), F.floor(F.col("ts_ms") / 86_400_000).alias("day"), (F.col("ts_ms") * 100_000 + F.col("seq")).alias("ts_ms"), F.lit(0.2).alias("epsilon"))
    return sharing.within_budget(q).where("granted").groupBy("agreement").agg(F.count("*").alias("granted"))


@query("p_erasure", "SELECT * FROM (VALUES ('events', 0, true), ('latest', 0, true)) x(\"table\", \"left\", clean)", telemetry=False)
def p_erasure(spark, sf):
    t = telemetry(spark, sf)
    gone = t.select("vehicle_pid").distinct().where(F.col("vehicle_pid").cast("int") % 7 == 0)
    kept = sharing.erased(t, gone)
    return sharing.erasure_report({"events": kept, "latest": sharing.erased(live.latest(t), gone)}, gone)


def audit(spark, sf):
    return telemetry(spark, sf).select("tenant_id", "seq", F.concat_ws(",", "vehicle_pid", F.col("k").cast("string")).alias("payload"))


@query("p_audit_chain")
def p_audit_chain(spark, sf):
    return sharing.chained(audit(spark, sf))


ORACLE["p_audit_chain"] = f"""WITH RECURSIVE {TELEMETRY}, p AS (SELECT tenant_id, seq, vehicle_pid || ',' || k AS payload, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS rn FROM t),
c AS (SELECT tenant_id, seq, payload, rn, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || ':' || payload) AS hash FROM p WHERE rn = 1 UNION ALL SELECT p.tenant_id, p.seq, p.payload, p.rn, c.hash, sha256(c.hash || ':' || p.payload) FROM c JOIN p ON p.tenant_id = c.tenant_id AND p.rn = c.rn + 1)
SELECT tenant_id, seq, payload, prev_hash, hash FROM c"""


@query("q_audit", "SELECT tenant_id, count(*) AS entries, CASE WHEN tenant_id = 3 THEN 2 ELSE 0 END AS broken FROM t GROUP BY 1")
def q_audit(spark, sf):
    """Links that don't hold, once one tenant's first payload and last hash were changed behind the chain's back."""
    log = sharing.chained(audit(spark, sf))
    ends = log.where("tenant_id = 3").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    log = log.join(ends, F.col("tenant_id") == 3, "left")
    payload = F.when(F.col("seq") == F.col("lo"), F.lit("x")).otherwise(F.col("payload"))
    hashed = F.when(F.col("seq") == F.col("hi"), F.lit("y")).otherwise(F.col("hash"))
    return sharing.verified_chain(log.withColumns({"payload": payload, "hash": hashed}).drop("lo", "hi"))


# request surface ---------------------------------------------------------------------------------


@query("q_vehicles", f", {LIVE} SELECT vehicle_pid, status FROM lv WHERE tenant_id = 1 AND status = 'PARKED' AND vehicle_pid > '2' ORDER BY vehicle_pid LIMIT 10")
def q_vehicles(spark, sf):
    v = live.live_state(telemetry(spark, sf)).where("tenant_id = 1 and status = 'PARKED' and vehicle_pid > '2'")
    return v.orderBy("vehicle_pid").limit(10).select("vehicle_pid", "status")


@query("q_trace", f"SELECT ts_ms - ts_ms % 60000 AS bucket_ms, {r('avg(speed_kmh)')} AS avg_speed FROM t WHERE vehicle_pid = '7' GROUP BY 1 ORDER BY 1")
def q_trace(spark, sf):
    t = telemetry(spark, sf).where("vehicle_pid = '7'")
    return t.groupBy(rollups.bucket("ts_ms", 60_000).alias("bucket_ms")).agg(rc(F.avg("speed_kmh")).alias("avg_speed")).orderBy("bucket_ms")


BOX = (13.01, 80.21, 13.06, 80.29)
BOX_SQL = "lat_e6 BETWEEN 13010000 AND 13060000 AND lon_e6 BETWEEN 80210000 AND 80290000"


@query("q_map_clusters", f", {LIVE} SELECT substr(gh6, 1, 5) AS cell, count(*) AS vehicles FROM lv WHERE {BOX_SQL} GROUP BY 1")
def q_map_clusters(spark, sf):
    v = live.in_box(live.live_state(telemetry(spark, sf)), *BOX)
    return v.groupBy(F.substr("geohash6", F.lit(1), F.lit(5)).alias("cell")).agg(F.count("*").alias("vehicles"))


@query("q_map_vehicles", f", {LIVE} SELECT vehicle_pid, lat_e6, lon_e6, status FROM lv WHERE {BOX_SQL} ORDER BY vehicle_pid LIMIT 100")
def q_map_vehicles(spark, sf):
    return live.in_box(live.live_state(telemetry(spark, sf)), *BOX).orderBy("vehicle_pid").limit(100).select("vehicle_pid", "lat_e6", "lon_e6", "status")


@query("src_redis_live", f", {LIVE} SELECT vehicle_pid, ts_ms, status FROM lv WHERE tenant_id = 2 AND vehicle_pid = '7'")
def src_redis_live(spark, sf):
    return live.live_state(telemetry(spark, sf)).where("tenant_id = 2 and vehicle_pid = '7'").select("vehicle_pid", "ts_ms", "status")


@query("src_redis_clusters", f", {LIVE} SELECT substr(gh6, 1, 4) AS cell, count(*) AS vehicles FROM lv WHERE tenant_id = 1 GROUP BY 1")
def src_redis_clusters(spark, sf):
    return live.cell_counts(live.live_state(telemetry(spark, sf)), (4,)).where("tenant_id = 1").select("cell", "vehicles")


@query("q_trips", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20", telemetry=False)
def q_trips(spark, sf):
    return paging.keyset_page(table(spark, sf, "orders").where("o_custkey = 7 and o_orderstatus = 'F'"), "o_orderdate", "o_orderkey", 20).select("o_orderkey", "o_totalprice")


@query("q_cost_summary", f"SELECT c_mktsegment AS fleet, count(*) AS trips, {r('sum(o_totalprice)', 1)} AS cost FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1", telemetry=False)
def q_cost_summary(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    day = F.col("o_orderdate")
    j = o.where((day >= F.lit("1995-01-01").cast("timestamp_ntz")) & (day < F.lit("1996-01-01").cast("timestamp_ntz"))).join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy(F.col("c_mktsegment").alias("fleet")).agg(F.count("*").alias("trips"), rc(F.sum("o_totalprice"), 1).alias("cost"))


@query("q_idling_top", f", {IDLE} SELECT vehicle_pid, CAST(sum(duration_s) AS BIGINT) AS idle_s FROM ep WHERE start_ms >= {T0_MS + 1_000_000} GROUP BY 1 ORDER BY idle_s DESC, vehicle_pid LIMIT 10")
def q_idling_top(spark, sf):
    e = episodes.idle_episodes(telemetry(spark, sf)).where(F.col("start_ms") >= T0_MS + 1_000_000)
    return rollups.top_idlers(e, 10).select("vehicle_pid", "idle_s")


@query("q_utilization", "SELECT vehicle_pid, count(*) AS samples, count(*) FILTER (speed_kmh >= 5) AS active FROM t GROUP BY 1")
def q_utilization(spark, sf):
    return telemetry(spark, sf).groupBy("vehicle_pid").agg(F.count("*").alias("samples"), F.count_if(F.col("speed_kmh") >= 5).alias("active"))


@query("q_opportunities", f", {IDLE}, z AS (SELECT 'IDLE' AS kind, vehicle_pid, sum(avoidable_cost) AS saving FROM ep GROUP BY 2 UNION ALL SELECT 'CHARGING', vehicle_pid, sum(charge_kw) * 0.001 FROM t GROUP BY 2) SELECT kind, vehicle_pid, {r('saving', 4)} AS saving FROM z WHERE saving > 0.05")
def q_opportunities(spark, sf):
    t = telemetry(spark, sf)
    i = episodes.idle_episodes(t).groupBy("vehicle_pid").agg(F.sum("avoidable_cost").alias("saving")).withColumn("kind", F.lit("IDLE"))
    c = t.groupBy("vehicle_pid").agg((F.sum("charge_kw") * 0.001).alias("saving")).withColumn("kind", F.lit("CHARGING"))
    return i.unionByName(c).where("saving > 0.05").select("kind", "vehicle_pid", rc(F.col("saving"), 4).alias("saving"))


@query("q_ev_fleet_status", f", {LIVE} SELECT count(*) AS vehicles, count(*) FILTER (status = 'CHARGING') AS charging, count(*) FILTER (soc_pct <= 15) AS at_risk FROM lv WHERE tenant_id = 3")
def q_ev_fleet_status(spark, sf):
    return rollups.fleet_status(live.live_state(telemetry(spark, sf))).where("tenant_id = 3").select("vehicles", "charging", "at_risk")


@query("q_battery_health", f", {CHARGE} SELECT vehicle_pid, soh_estimate, start_ms FROM se WHERE tenant_id = 2 AND soh_estimate IS NOT NULL")
def q_battery_health(spark, sf):
    return episodes.charging_sessions(telemetry(spark, sf)).where("tenant_id = 2 and soh_estimate is not null").select("vehicle_pid", "soh_estimate", "start_ms")


@query("q_drivers", f", {SCORES}, rk AS (SELECT driver, {r('score', 4)} AS score FROM ds) SELECT driver, score, dense_rank() OVER (ORDER BY score) AS rank FROM rk ORDER BY score, driver LIMIT 20")
def q_drivers(spark, sf):
    s = scores(spark, sf).select("driver", rc(F.col("score"), 4).alias("score"))
    return paging.leaderboard(s, "score", "driver", ascending=True).select("driver", "score", F.col("rank").cast("bigint").alias("rank")).orderBy("score", "driver").limit(20)


@query("q_safety_events", f", {DELTAS} SELECT vehicle_pid, ts_ms, event AS event_type FROM c WHERE vehicle_pid = '7' AND ts_ms BETWEEN {T0_MS} AND {T0_MS + 3_000_000}")
def q_safety_events(spark, sf):
    return safety.candidates(telemetry(spark, sf)).where((F.col("vehicle_pid") == "7") & F.col("ts_ms").between(T0_MS, T0_MS + 3_000_000)).select("vehicle_pid", "ts_ms", "event_type")


@query("f_time_range_events", f", {DELTAS} SELECT event AS event_type, count(*) AS n FROM c WHERE ts_ms < {T0_MS + 2_000_000} GROUP BY 1")
def f_time_range_events(spark, sf):
    return safety.candidates(telemetry(spark, sf)).where(F.col("ts_ms") < T0_MS + 2_000_000).groupBy("event_type").agg(F.count("*").alias("n"))


@query("q_geofences", f"WITH {FENCE_SQL} SELECT CAST(fence_id AS INTEGER) AS fence_id, type FROM f WHERE fence_id <> 3 UNION ALL SELECT 4, 'NEW'", telemetry=False)
def q_geofences(spark, sf):
    f = fences(spark).select("fence_id", "type")
    return f.join(spark.createDataFrame([(3,)], "fence_id int"), "fence_id", "left_anti").unionByName(spark.createDataFrame([(4, "NEW")], "fence_id int, type string"))


@query("p_geofence_crud", f"WITH {FENCE_SQL} SELECT CAST(fence_id AS INTEGER) AS fence_id, CASE WHEN fence_id = 2 THEN 'SITE' ELSE type END AS type FROM f", telemetry=False)
def p_geofence_crud(spark, sf):
    from motorcade.sources.writers import upserted

    f = fences(spark).select("fence_id", "type").withColumn("version", F.lit(1))
    return upserted(f, spark.createDataFrame([(2, "SITE", 2)], f.schema), ["fence_id"], "version").drop("version")


@query("q_anomalies")
def q_anomalies(spark, sf):
    t = telemetry(spark, sf)
    tow = episodes.tow_alerts(parked(t)).select("vehicle_pid", F.lit("TOW").alias("kind"))
    rare = rollups.activity_profile(t).where("rare").select("vehicle_pid", F.lit("RARE_HOUR").alias("kind"))
    return tow.unionByName(rare).groupBy("vehicle_pid", "kind").agg(F.count("*").alias("n"))


recursive("q_anomalies", f"{TOW}, {cooldown_sql('x', 300_000, True)} SELECT vehicle_pid, 'TOW' AS kind, count(*) AS n FROM cooled GROUP BY 1")


@query("q_unapproved_depots")
def q_unapproved_depots(spark, sf):
    from motorcade.plans.relational import u_union_find

    c = u_union_find(spark, sf)
    return c.groupBy("component").agg(F.count("*").alias("cells")).where("cells >= 2")


@query("q_alerts", f", {LIVE} SELECT vehicle_pid, CASE WHEN soc_pct <= 8 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM lv WHERE soc_pct <= 15 ORDER BY severity, ts_ms DESC, vehicle_pid LIMIT 20")
def q_alerts(spark, sf):
    v = live.live_state(telemetry(spark, sf)).where("soc_pct <= 15").withColumn("severity", F.when(F.col("soc_pct") <= 8, "CRITICAL").otherwise("HIGH"))
    return v.orderBy("severity", F.col("ts_ms").desc(), "vehicle_pid").limit(20).select("vehicle_pid", "severity")


@query("p_alert_patch", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ACK' ELSE 'OPEN' END AS status FROM t WHERE k < 3")
def p_alert_patch(spark, sf):
    from motorcade.sources.writers import upserted

    a = telemetry(spark, sf).where("k < 3").select("event_id", F.lit("OPEN").alias("status"), F.lit(1).alias("version"))
    return upserted(a, a.where("event_id % 2 = 0").withColumns({"status": F.lit("ACK"), "version": F.lit(2)}), ["event_id"], "version").drop("version")


@query("q_admin_mappings", "SELECT * FROM (VALUES ('A', 1, 'ACTIVE'), ('A', 2, 'SHADOW'), ('B', 1, 'ACTIVE'), ('C', 1, 'ACTIVE'), ('D', 1, 'ACTIVE'), ('E', 1, 'ACTIVE'), ('E', 2, 'ACTIVE')) x(oem, schema_ver, state)", telemetry=False)
def q_admin_mappings(spark, sf):
    from motorcade.operators.mapping import BUILT_IN, Registry

    reg = Registry()
    reg.register(BUILT_IN[0] | {"schema_ver": 2}, shadow=True)
    return reg.frame(spark).select("oem", "schema_ver", "state")


# generators --------------------------------------------------------------------------------------


@query("gen_oem", f"SELECT k % 6 AS kind, count(*) AS n FROM t WHERE event_id % 50 <> 0 GROUP BY 1")
def gen_oem(spark, sf):
    from motorcade.plans.scalars import payloads

    p = payloads(spark, sf).where("event_id % 50 <> 0")
    raw = F.col("raw")
    kind = F.when(raw.startswith("D1|"), 3).when(raw.contains('"vehicleId"'), 0).when(raw.contains("ts_epoch"), 1).when(raw.contains("deviceId"), 2).when(raw.contains('"loc"'), 5).otherwise(4)
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


for _kind, _name in enumerate(("gen_oem_a", "gen_oem_b", "gen_oem_c", "gen_oem_d", "gen_oem_e1", "gen_oem_e2")):

    @query(_name, f"SELECT event_id, {'floor(lat_e6 / 10.0 + 0.5)::INTEGER * 10' if _kind == 3 else 'lat_e6'} AS lat_e6, ts_ms AS ts_event FROM t WHERE event_id % 50 <> 0 AND k % 6 = {_kind}")
    def _encoded(spark, sf, kind=_kind):
        from motorcade.plans.edges import _mapped

        return _mapped(spark, sf, kind, kind, "lat_e6", "ts_event").drop("lacks")


@query("gen_ground_truth", f", {DELTAS} SELECT event_id, CASE WHEN accel <= -3.0 THEN 'BRAKE' WHEN accel >= 2.5 THEN 'ACCEL' WHEN speed_kmh > 110 THEN 'OVERSPEED' ELSE 'NONE' END AS label FROM a WHERE dt_ms > 0")
def gen_ground_truth(spark, sf):
    a = F.col("accel_ms2")
    label = F.when(a <= -3.0, "BRAKE").when(a >= 2.5, "ACCEL").when(F.col("speed_kmh") > 110, "OVERSPEED").otherwise("NONE")
    return safety.deltas(telemetry(spark, sf)).where("dt_ms > 0").select("event_id", label.alias("label"))


@query("gen_chaos", """SELECT event_id, c AS copy, ts_ms + CASE WHEN event_id % 33 = 0 THEN 4000 WHEN event_id % 500 = 7 THEN 60000 ELSE 0 END + c AS arrival, ts_ms + CASE WHEN event_id % 400 = 9 THEN 7200000 ELSE 0 END AS ts_ms,
lat_e6 + CASE WHEN event_id % 1000 = 3 THEN 5000000 ELSE 0 END AS lat_e6, CASE WHEN event_id % 700 = 5 THEN 'X' || substr(vehicle_pid, 2) ELSE vehicle_pid END AS vehicle_pid FROM t, (VALUES (0), (1)) x(c) WHERE c = 0 OR event_id % 66 = 0""")
def gen_chaos(spark, sf):
    """Copies (1.5 %), disorder by seconds (3 %) and a minute (0.2 %), clocks two hours ahead, jumps of 5 degrees and broken
    vehicle ids, all by the event's id, so the same on every run."""
    i = F.col("event_id")
    t = telemetry(spark, sf).withColumn("copy", F.explode(F.when(i % 66 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return t.select(
        "event_id",
        "copy",
        (F.col("ts_ms") + F.when(i % 33 == 0, 4000).when(i % 500 == 7, 60_000).otherwise(0) + F.col("copy")).alias("arrival"),
        (F.col("ts_ms") + F.when(i % 400 == 9, 7_200_000).otherwise(0)).alias("ts_ms"),
        (F.col("lat_e6") + F.when(i % 1000 == 3, 5_000_000).otherwise(0)).alias("lat_e6"),
        F.when(i % 700 == 5, F.concat(F.lit("X"), F.substr("vehicle_pid", F.lit(2)))).otherwise(F.col("vehicle_pid")).alias("vehicle_pid"),
    )


@query("gen_world", f"WITH {_grid_sql()} SELECT src, count(*) AS degree FROM e GROUP BY 1", telemetry=False)
def gen_world(spark, sf):
    return grid(spark)[1].groupBy("src").agg(F.count("*").alias("degree"))


@query("gen_seed", "SELECT CAST(i AS INTEGER) AS tenant, floor(1000 / pow(i + 1, 0.8)) AS vehicles FROM range(0, 40) x(i)", telemetry=False)
def gen_seed(spark, sf):
    return spark.range(40).select(F.col("id").cast("int").alias("tenant"), F.floor(1000 / F.pow(F.col("id") + 1, F.lit(0.8))).cast("double").alias("vehicles"))


@query("gen_driver_profile")
def gen_driver_profile(spark, sf):
    """Aggression as the second smallest of six uniforms drawn by hash, which is Beta(2, 5)."""
    drawn = lambda i: F.conv(F.substr(F.md5(F.concat(F.lit(f"{i}:"), "vehicle_pid")), F.lit(1), F.lit(7)), 16, 10).cast("bigint")
    u = F.array_sort(F.array(*[(drawn(i) + 0.5) / float(1 << 28) for i in range(6)]))
    return telemetry(spark, sf).select("vehicle_pid").distinct().select("vehicle_pid", F.get(u, F.lit(1)).alias("aggression"))


class Battery:
    columns, schema = ("charge_kw", "speed_kmh"), "soc double"
    start = {"soc": 50.0}

    def step(self, state, row):
        soc = np.clip(state["soc"] + row["charge_kw"] / 60 * 5 - row["speed_kmh"] * 0.01, 0.0, 100.0)
        return {"soc": soc}, {"when": np.ones(len(soc), bool), "soc": soc}


@query("gen_physics")
def gen_physics(spark, sf):
    """Charge after each step of driving and charging, between 0 and 100."""

    t = telemetry(spark, sf).select("vehicle_pid", "ts_ms", "seq", "charge_kw", "speed_kmh")
    return lockstep.run(t, "vehicle_pid", ["ts_ms", "seq"], Battery(), ["vehicle_pid", "ts_ms", "seq"]).withColumn("soc", rc(F.col("soc"), 6))


@query("q_live_status", f", {LATEST} SELECT {STATUS} AS status, count(*) AS n FROM l GROUP BY 1")
def q_live_status(spark, sf):
    return live.live_state(telemetry(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))

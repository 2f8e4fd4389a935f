"""Queries of joins, aggregations, windows, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motorcade.functions.codes import dtc_severity
from motorcade.functions.geo import haversine
from motorcade.operators import episodes, geofence, joins, live, paging, rollups, safety
from motorcade.operators.algorithms import adjacent_cells, components
from motorcade.plans.base import query
from motorcade.plans.telemetry import T0_MS, geohash_sql, haversine_sql, r, rc, table, telemetry
from motorcade.sources import writers

LAT, LON = "lat_e6 / 1e6", "lon_e6 / 1e6"
LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms DESC, seq) AS rn FROM t) WHERE rn = 1)"
STATUS = "CASE WHEN charge_state = 'CHARGING' THEN 'CHARGING' WHEN NOT ignition THEN 'PARKED' WHEN speed_kmh >= 5 THEN 'DRIVING' ELSE 'IDLE' END"
FENCES = [(1, "DEPOT", 13.02, 80.25, 2500.0), (2, "RESTRICTED", 13.05, 80.28, 3000.0), (3, "SITE", 13.08, 80.22, 2000.0)]
FENCE_SQL = "f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {a}::DOUBLE, {b}::DOUBLE, {m}::DOUBLE)" for i, k, a, b, m in FENCES) + ") x(fence_id, type, lat, lon, radius_m))"
PERIODS = [("OFF_PEAK", 0, 360, 127, 0.12), ("PEAK", 360, 1320, 31, 0.28), ("DAY", 360, 1320, 96, 0.18), ("OFF_PEAK", 1320, 1440, 127, 0.12)]


def fences(spark):
    return spark.createDataFrame(FENCES, "fence_id int, type string, lat double, lon double, radius_m double")


# joins -------------------------------------------------------------------------------------------


@query("j_vin_lookup", "SELECT vehicle_pid, count(*) AS n, CAST(vehicle_pid AS INTEGER) % 11 <> 0 AS known FROM t GROUP BY 1")
def j_vin_lookup(spark, sf):
    from motorcade.plans.scalars import registry, with_vin

    known, unknown = joins.split_known(with_vin(telemetry(spark, sf)).select("vin", "vehicle_pid"), registry(spark, sf).select("vin"), "vin")
    rows = known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return rows.groupBy("vehicle_pid", "known").agg(F.count("*").alias("n"))


@query("j_mapping_lookup", "SELECT k % 6 AS kind, count(*) AS n, CASE k % 6 WHEN 2 THEN 'signal_list' WHEN 3 THEN 'delimited' ELSE 'json' END AS format FROM t GROUP BY 1, 3")
def j_mapping_lookup(spark, sf):
    from motorcade.operators.mapping import Registry

    kinds = spark.createDataFrame([(0, "A", 1), (1, "B", 1), (2, "C", 1), (3, "D", 1), (4, "E", 1), (5, "E", 2)], "kind int, oem string, schema_ver int")
    t = telemetry(spark, sf).select((F.col("k") % 6).alias("kind")).join(kinds, "kind")
    return t.join(Registry().frame(spark).select("oem", "schema_ver", "format"), ["oem", "schema_ver"]).groupBy("kind", "format").agg(F.count("*").alias("n"))


@query("j_geofence", f", {FENCE_SQL} SELECT event_id, fence_id, {r(haversine_sql('lat', 'lon', LAT, LON), 2)} AS m FROM t, f WHERE {haversine_sql('lat', 'lon', LAT, LON)} <= radius_m")
def j_geofence(spark, sf):
    return geofence.inside_circles(telemetry(spark, sf), fences(spark)).select("event_id", "fence_id", rc(F.col("distance_m"), 2).alias("m"))


@query("j_geofence_polygon", None)
def j_geofence_polygon(spark, sf):
    from motorcade.plans.scalars import RING

    ring = spark.createDataFrame([(1, [{"lat": a, "lon": b} for a, b in RING])], "fence_id int, ring array<struct<lat:double,lon:double>>")
    return geofence.inside_polygons(telemetry(spark, sf), ring).select("event_id", "fence_id")


def _polygon_sql():
    from motorcade.plans.base import ORACLE
    from motorcade.plans.scalars import _ring_sql
    from motorcade.plans.telemetry import TELEMETRY

    ORACLE["j_geofence_polygon"] = f"WITH {TELEMETRY} SELECT event_id, 1 AS fence_id FROM ({_ring_sql()}) WHERE inside"


_polygon_sql()


@query("j_lateral_latest", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1", telemetry=False)
def j_lateral_latest(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_latest(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("j_asof_driver", f", a AS (SELECT DISTINCT vehicle_pid, CAST(vehicle_pid AS INTEGER) * 2 + s AS driver, {T0_MS} + s * 2000000 AS valid_from, CASE WHEN s = 0 THEN {T0_MS + 2_000_000} END AS valid_to FROM t, (VALUES (0), (1)) x(s)) SELECT driver, count(*) AS n FROM t JOIN a USING (vehicle_pid) WHERE ts_ms >= valid_from AND (valid_to IS NULL OR ts_ms < valid_to) GROUP BY 1")
def j_asof_driver(spark, sf):
    t = telemetry(spark, sf)
    s = F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    a = t.select("vehicle_pid").distinct().select("vehicle_pid", s).select("vehicle_pid", (F.col("vehicle_pid").cast("int") * 2 + F.col("s")).alias("driver"), (F.lit(T0_MS) + F.col("s") * 2_000_000).alias("valid_from"), F.when(F.col("s") == 0, F.lit(T0_MS + 2_000_000)).alias("valid_to"))
    return joins.in_interval(t, a, "vehicle_pid", "ts_ms").groupBy("driver").agg(F.count("*").alias("n"))


@query("j_asof_fuel_price", f""", p AS (SELECT CASE WHEN d % 2 = 0 THEN 'purchase' ELSE 'view' END AS fuel, {T0_MS} + d * 300000 AS valid_from, 1.4 + d * 0.01 AS price FROM range(0, 12) x(d)),
q AS (SELECT event_id, ts_ms, CASE WHEN charge_state = 'CHARGING' THEN 'purchase' ELSE 'view' END AS fuel FROM t)
SELECT event_id, price FROM q ASOF LEFT JOIN p ON q.fuel = p.fuel AND q.ts_ms >= p.valid_from""")
def j_asof_fuel_price(spark, sf):
    fuel = F.when(F.col("charge_state") == "CHARGING", "purchase").otherwise("view").alias("fuel")
    p = spark.range(12).select(F.when(F.col("id") % 2 == 0, "purchase").otherwise("view").alias("fuel"), (F.lit(T0_MS) + F.col("id") * 300_000).alias("valid_from"), (1.4 + F.col("id") * 0.01).alias("price"))
    return joins.as_of(telemetry(spark, sf).select("event_id", "ts_ms", fuel), p, "fuel", "ts_ms", "valid_from", "price").select("event_id", "price")


@query("j_range_tariff", ", q AS (SELECT event_id, hour(make_timestamp(ts_ms * 1000)) * 60 + minute(make_timestamp(ts_ms * 1000)) AS m, 1 << CAST(isodow(make_timestamp(ts_ms * 1000)) - 1 AS INTEGER) AS bit FROM t), p AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {d}, {p}::DOUBLE)" for n, a, b, d, p in PERIODS) + ") x(period, start_min, end_min, dow_mask, price)) SELECT event_id, period, price FROM q, p WHERE m >= start_min AND m < end_min AND (dow_mask & bit) > 0")
def j_range_tariff(spark, sf):
    p = spark.createDataFrame(PERIODS, "period string, start_min int, end_min int, dow_mask int, price double")
    return joins.tariff_periods(telemetry(spark, sf), p).select("event_id", "period", "price")


@query("j_nearest_charger", f", {LATEST}, c AS (SELECT CAST(i AS INTEGER) AS charger, 13.0 + i * 0.01 AS clat, 80.2 + (i % 5) * 0.03 AS clon FROM range(0, 12) x(i)), d AS (SELECT vehicle_pid, charger, {haversine_sql(LAT, LON, 'clat', 'clon')} AS m FROM l, c) SELECT vehicle_pid, charger, rank FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_pid ORDER BY m, charger) AS rank FROM d) WHERE rank <= 3")
def j_nearest_charger(spark, sf):
    c = spark.range(12).select(F.col("id").cast("int").alias("charger"), (13.0 + F.col("id") * 0.01).alias("lat"), (80.2 + (F.col("id") % 5) * 0.03).alias("lon"))
    v = live.latest(telemetry(spark, sf)).select("vehicle_pid", F.expr(LAT).alias("lat"), F.expr(LON).alias("lon"))
    return joins.nearest(v, c, 3, "vehicle_pid", "charger").select("vehicle_pid", "charger", F.col("rank").cast("bigint").alias("rank"))


@query("j_anti_erasure", "SELECT event_id FROM t WHERE CAST(vehicle_pid AS INTEGER) % 7 <> 0")
def j_anti_erasure(spark, sf):
    t = telemetry(spark, sf)
    gone = t.select("vehicle_pid").distinct().where(F.col("vehicle_pid").cast("int") % 7 == 0)
    return t.join(gone, "vehicle_pid", "left_anti").select("event_id")


@query("j_ledger_reconcile", "SELECT vehicle_pid, count(*) AS expected, count(*) FILTER (event_id % 13 <> 0) + count(*) FILTER (event_id % 20 = 0 AND event_id % 13 <> 0) AS landed, count(*) FILTER (event_id % 13 <> 0) AS landed_distinct, count(*) FILTER (event_id % 13 = 0) AS missing, 0 AS unexpected, count(*) FILTER (event_id % 20 = 0 AND event_id % 13 <> 0) AS duplicates FROM t GROUP BY 1")
def j_ledger_reconcile(spark, sf):
    t = telemetry(spark, sf).select("vehicle_pid", "event_id")
    landed = t.where("event_id % 13 <> 0")
    return joins.reconcile(t, landed.unionByName(landed.where("event_id % 20 = 0")), "vehicle_pid", "event_id")


@query("j_dim_star", "SELECT r_name, n_name, c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3", telemetry=False)
def j_dim_star(spark, sf):
    o, c, n, g = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"))


@query("j_dtc_catalog", "SELECT event_id, code, CASE code WHEN 'P0301' THEN 'CRITICAL' WHEN 'P0420' THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM t WHERE code IS NOT NULL")
def j_dtc_catalog(spark, sf):
    catalog = spark.createDataFrame([("P0301", "CRITICAL")], "code string, listed string")
    rows = telemetry(spark, sf).select("event_id", F.explode("dtc").alias("code"))
    return rows.join(catalog, "code", "left").select("event_id", "code", F.coalesce("listed", dtc_severity(F.col("code"))).alias("severity"))


@query("j_consent_semi", "SELECT event_id FROM t WHERE tenant_id IN (1, 3)")
def j_consent_semi(spark, sf):
    consent = spark.createDataFrame([(1,), (3,)], "tenant_id int")
    return telemetry(spark, sf).join(consent, "tenant_id", "left_semi").select("event_id")


# aggregations ------------------------------------------------------------------------------------


@query("agg_10s_rollup", f"SELECT tenant_id, vehicle_pid, ts_ms - ts_ms % 10000 AS bucket_ms, {r('avg(speed_kmh)')} AS avg_speed, max(speed_kmh) AS max_speed, arg_max(lat_e6, (ts_ms, seq)) AS last_lat_e6, arg_max(lon_e6, (ts_ms, seq)) AS last_lon_e6, min(soc_pct) AS min_soc FROM t GROUP BY 1, 2, 3")
def agg_10s_rollup(spark, sf):
    return rollups.rollup_10s(telemetry(spark, sf)).withColumn("avg_speed", rc(F.col("avg_speed")))


STEPS = "s AS (SELECT *, CASE WHEN d > 0 AND d < 300000 THEN d ELSE 0 END AS dt FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS d FROM t))"


@query("agg_minute_summary", f", {STEPS} SELECT tenant_id, vehicle_pid, ts_ms - ts_ms % 60000 AS minute_ms, CAST(sum(CASE WHEN ignition THEN dt ELSE 0 END) AS BIGINT) AS engine_on_ms, CAST(sum(CASE WHEN ignition AND speed_kmh < 2 THEN dt ELSE 0 END) AS BIGINT) AS idle_ms, {r("sum(CASE WHEN charge_state = 'CHARGING' THEN charge_kw * dt / 3600000.0 ELSE 0.0 END)")} AS energy_kwh, {r('sum(speed_kmh * dt / 3600000.0)')} AS distance_km FROM s GROUP BY 1, 2, 3")
def agg_minute_summary(spark, sf):
    m = rollups.minute_summary(telemetry(spark, sf))
    return m.withColumn("energy_kwh", rc(F.col("energy_kwh"))).withColumn("distance_km", rc(F.col("distance_km")))


def _orders(spark, sf):
    """Orders as trips, line items as idling and charging: customers are vehicles, nations tenants."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("tenant_id"))
    o = table(spark, sf, "orders").join(c, "o_custkey").withColumn("vehicle_pid", F.col("o_custkey").cast("string")).withColumn("start_ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return o


COST_SQL = """
o AS (SELECT orders.*, c_nationkey AS tenant_id, CAST(o_custkey AS VARCHAR) AS vehicle_pid, epoch_ms(o_orderdate) - epoch_ms(o_orderdate) % 86400000 AS day_ms FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT tenant_id, vehicle_pid, day_ms, sum(o_totalprice) AS trip_cost, sum(o_totalprice / 10) AS km, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 20 ELSE 0 END) AS idle_cost, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 50 ELSE 0 END) AS charge_cost FROM o GROUP BY 1, 2, 3)"""


def _cost_daily(spark, sf):
    o = _orders(spark, sf)
    trips = o.select("tenant_id", "vehicle_pid", "start_ms", F.col("o_totalprice").alias("cost"), (F.col("o_totalprice") / 10).alias("distance_km"), F.lit(0.0).alias("co2_kg"), F.lit(0).alias("duration_s"))
    idles = o.where("o_orderstatus = 'O'").select("tenant_id", "vehicle_pid", "start_ms", (F.col("o_totalprice") / 20).alias("cost"), F.lit(0.0).alias("avoidable_cost"), F.lit(0.0).alias("co2_kg"))
    charges = o.where("o_orderstatus = 'F'").select("tenant_id", "vehicle_pid", "start_ms", (F.col("o_totalprice") / 50).alias("smart_cost"))
    return rollups.cost_daily(trips, idles, charges)


@query("agg_cost_daily", f"WITH {COST_SQL} SELECT tenant_id, vehicle_pid, day_ms, {r('trip_cost + idle_cost + charge_cost', 2)} AS total_cost, {r('(trip_cost + idle_cost + charge_cost) / km')} AS cost_per_km FROM d", telemetry=False)
def agg_cost_daily(spark, sf):
    return _cost_daily(spark, sf).select("tenant_id", "vehicle_pid", "day_ms", rc(F.col("total_cost"), 2).alias("total_cost"), rc(F.col("cost_per_km")).alias("cost_per_km"))


@query("agg_fleet_cost_daily", f"WITH {COST_SQL} SELECT tenant_id, day_ms, count(*) AS vehicles, {r('sum(km)', 4)} AS km, {r('sum(trip_cost)', 4)} AS cost FROM d GROUP BY 1, 2", telemetry=False)
def agg_fleet_cost_daily(spark, sf):
    return _cost_daily(spark, sf).groupBy("tenant_id", "day_ms").agg(F.count("*").alias("vehicles"), rc(F.sum("km"), 4).alias("km"), rc(F.sum("trip_cost"), 4).alias("cost"))


@query("agg_cost_summary", f"WITH {COST_SQL} SELECT tenant_id, count(*) AS rows, {r('sum(trip_cost + idle_cost + charge_cost)', 1)} AS cost, {r('sum(km)', 1)} AS km FROM d GROUP BY ROLLUP (tenant_id)", telemetry=False)
def agg_cost_summary(spark, sf):
    return _cost_daily(spark, sf).rollup("tenant_id").agg(F.count("*").alias("rows"), rc(F.sum("total_cost"), 1).alias("cost"), rc(F.sum("km"), 1).alias("km"))


ISLANDS = "i AS (SELECT *, sum(ch) OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN inside <> lag(inside) OVER w THEN 1 ELSE 0 END AS ch, lead(ts_ms) OVER w AS next_ms, lag(ts_ms) OVER w AS prev_ms FROM (SELECT *, {cond} AS inside FROM t) WINDOW w AS (PARTITION BY vehicle_pid ORDER BY ts_ms, seq)))"
IDLE = ISLANDS.format(cond="ignition AND charge_state <> 'CHARGING' AND speed_kmh < 2") + f""",
ir AS (SELECT vehicle_pid, tenant_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, arg_max(next_ms, (ts_ms, seq)) AS end_ms, arg_min(lat_e6, (ts_ms, seq)) AS lat_e6, bool_or(next_ms IS NULL) AS open FROM i WHERE inside GROUP BY vehicle_pid, tenant_id, island),
e AS (SELECT *, greatest(120, (end_ms - start_ms) // 1000) AS duration_s FROM ir WHERE NOT open AND (last_ms - start_ms) // 1000 >= 120),
ep AS (SELECT vehicle_pid, tenant_id, start_ms, end_ms, duration_s, lat_e6, {r('duration_s / 3600.0 * 1.5')} AS fuel_l, {r('duration_s / 3600.0 * 1.5 * 1.45', 2)} AS cost, {r('greatest(0.0, duration_s / 60.0 - 10.0) * (1.5 / 60.0 * 1.45)', 2)} AS avoidable_cost, {r('duration_s / 3600.0 * 1.5 * 2.31', 2)} AS co2_kg FROM e)"""


@query("st_idle", f", {IDLE} SELECT * FROM ep")
def st_idle(spark, sf):
    return episodes.idle_episodes(telemetry(spark, sf)).drop("idle_id", "lon_e6", "geohash7")


@query("w_islands_idle", ", " + ISLANDS.format(cond="ignition AND charge_state <> 'CHARGING' AND speed_kmh < 2") + " SELECT vehicle_pid, island, count(*) AS samples, max(ts_ms) - min(ts_ms) AS ms FROM i WHERE inside GROUP BY 1, 2")
def w_islands_idle(spark, sf):
    return episodes.islands(telemetry(spark, sf), episodes.idle_condition()).where("inside").groupBy("vehicle_pid", F.col("island").cast("decimal(38,0)").alias("island")).agg(F.count("*").alias("samples"), (F.max("ts_ms") - F.min("ts_ms")).alias("ms"))


@query("agg_top_idlers", f", {IDLE} SELECT vehicle_pid, CAST(sum(duration_s) AS BIGINT) AS idle_s, {r('sum(cost)', 2)} AS cost FROM ep GROUP BY 1 ORDER BY idle_s DESC, vehicle_pid LIMIT 20")
def agg_top_idlers(spark, sf):
    return rollups.top_idlers(episodes.idle_episodes(telemetry(spark, sf)), 20).withColumn("cost", rc(F.col("cost"), 2))


@query("agg_avoidable_day", f", {IDLE} SELECT vehicle_pid, start_ms - start_ms % 86400000 AS day_ms, {r('sum(duration_s) / 60.0')} AS idle_min, {r('greatest(0.0, sum(duration_s) / 60.0 - 10.0) * (sum(cost) / (sum(duration_s) / 60.0))')} AS avoidable_cost FROM ep GROUP BY 1, 2")
def agg_avoidable_day(spark, sf):
    d = rollups.avoidable_daily(episodes.idle_episodes(telemetry(spark, sf)))
    return d.select("vehicle_pid", "day_ms", rc(F.col("idle_min")).alias("idle_min"), rc(F.col("avoidable_cost")).alias("avoidable_cost"))


@query("agg_driver_score_daily")
def agg_driver_score_daily(spark, sf):
    c = safety.candidates(telemetry(spark, sf))
    n = lambda k: F.count_if(F.col("event_type") == k)
    return c.groupBy("vehicle_pid", rollups.bucket("ts_ms", rollups.DAY_MS).alias("day_ms")).agg(n("HARSH_BRAKE").alias("brakes"), n("HARSH_ACCEL").alias("accels"), n("HARSH_CORNER").alias("corners"), F.count("*").alias("events"))


DELTAS = """dl AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS dt_ms, speed_kmh - lag(speed_kmh) OVER w AS dv, abs(heading_deg - coalesce(lag(heading_deg) OVER w, 0)) AS turn FROM t WINDOW w AS (PARTITION BY vehicle_pid ORDER BY ts_ms, seq)),
a AS (SELECT *, CASE WHEN dt_ms > 0 THEN dv / 3.6 / (dt_ms / 1000.0) END AS accel, CASE WHEN dt_ms > 0 THEN CASE WHEN turn > 180 THEN 360 - turn ELSE turn END / (dt_ms / 1000.0) END AS rate FROM dl),
c AS (SELECT * FROM (SELECT *, CASE WHEN accel <= -3.5 THEN 'HARSH_BRAKE' WHEN accel >= 3.0 THEN 'HARSH_ACCEL' WHEN speed_kmh >= 30 THEN CASE WHEN rate >= 30 THEN 'HARSH_CORNER' END WHEN speed_kmh > 115 THEN 'OVERSPEED' END AS event FROM a WHERE dt_ms BETWEEN 200 AND 5000) WHERE event IS NOT NULL)"""


def _score_daily_sql():
    from motorcade.plans.base import ORACLE
    from motorcade.plans.telemetry import TELEMETRY

    ORACLE["agg_driver_score_daily"] = f"WITH {TELEMETRY}, {DELTAS} SELECT vehicle_pid, ts_ms - ts_ms % 86400000 AS day_ms, count(*) FILTER (event = 'HARSH_BRAKE') AS brakes, count(*) FILTER (event = 'HARSH_ACCEL') AS accels, count(*) FILTER (event = 'HARSH_CORNER') AS corners, count(*) AS events FROM c GROUP BY 1, 2"


_score_daily_sql()
LIVE = f"{LATEST}, lv AS (SELECT *, {STATUS} AS status, {geohash_sql(LAT, LON, 6)} AS gh6 FROM l)"


@query("agg_fleet_status", f", {LIVE} SELECT tenant_id, count(*) AS vehicles, count(*) FILTER (status = 'CHARGING') AS charging, count(*) FILTER (soc_pct <= 15) AS at_risk, {r('avg(soc_pct)')} AS avg_soc, count(*) FILTER (least(4, floor(soc_pct / 20)) = 0) AS soc_0, count(*) FILTER (least(4, floor(soc_pct / 20)) = 4) AS soc_80 FROM lv GROUP BY 1")
def agg_fleet_status(spark, sf):
    f = rollups.fleet_status(live.live_state(telemetry(spark, sf)))
    return f.select("tenant_id", "vehicles", "charging", "at_risk", rc(F.col("avg_soc")).alias("avg_soc"), "soc_0", "soc_80")


@query("agg_cluster_counts", f", {LIVE} SELECT tenant_id, CAST(p AS INTEGER) AS precision, substr(gh6, 1, CAST(p AS INTEGER)) AS cell, count(*) AS vehicles FROM lv, range(3, 7) x(p) GROUP BY 1, 2, 3")
def agg_cluster_counts(spark, sf):
    return live.cell_counts(live.live_state(telemetry(spark, sf)))


@query("agg_utilization", """, d AS (SELECT vehicle_pid, (ts_ms // 600000) AS day, count(*) / 4.0 AS hours FROM t GROUP BY 1, 2), x AS (SELECT vehicle_pid, day - row_number() OVER (PARTITION BY vehicle_pid ORDER BY day) AS run FROM d WHERE hours < 2),
y AS (SELECT vehicle_pid, max(n) AS longest FROM (SELECT vehicle_pid, run, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1) SELECT vehicle_pid, count(*) AS days, """ + r("avg(hours)") + """ AS hours, coalesce(max(longest), 0) AS longest, coalesce(max(longest), 0) >= 3 AS underused FROM d LEFT JOIN y USING (vehicle_pid) GROUP BY 1""")
def agg_utilization(spark, sf):
    d = telemetry(spark, sf).groupBy("vehicle_pid", F.floor(F.col("ts_ms") / 600_000).alias("day")).agg((F.count("*") / 4.0).alias("hours"))
    return rollups.utilisation(d, 2.0, 3).withColumn("hours", rc(F.col("hours")))


@query("agg_ledger", "SELECT vehicle_pid, count(*) AS rows, count(DISTINCT id) AS ids, CAST(sum(id) AS VARCHAR) AS id_sum FROM (SELECT vehicle_pid, CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 16)) AS UBIGINT)::HUGEINT AS id FROM t) GROUP BY 1")
def agg_ledger(spark, sf):
    from motorcade.functions.ids import to_u64

    return rollups.ledger(telemetry(spark, sf), "vehicle_pid", to_u64(F.substr(F.md5(F.col("event_id").cast("string")), F.lit(1), F.lit(16)))).withColumn("id_sum", F.col("id_sum").cast("string"))


@query("agg_usage_daily", "SELECT tenant_id, ts_ms - ts_ms % 3600000 AS hour_ms, count(DISTINCT vehicle_pid) AS vehicles FROM t GROUP BY 1, 2")
def agg_usage_daily(spark, sf):
    return telemetry(spark, sf).groupBy("tenant_id", rollups.bucket("ts_ms", 3_600_000).alias("hour_ms")).agg(F.countDistinct("vehicle_pid").alias("vehicles"))


@query("agg_distinct_approx")
def agg_distinct_approx(spark, sf):
    return rollups.sketches(telemetry(spark, sf), "tenant_id", "vehicle_pid").select("tenant_id", "distinct_items", F.length("sketch").alias("bytes"))


@query("agg_activity_profile")
def agg_activity_profile(spark, sf):
    return rollups.activity_profile(telemetry(spark, sf)).select("vehicle_pid", "dow", "hour", "active", "days", "probability", "rare")


def _profile_sql():
    from motorcade.plans.base import ORACLE
    from motorcade.plans.telemetry import TELEMETRY

    ORACLE["agg_activity_profile"] = f"WITH {TELEMETRY}, q AS (SELECT vehicle_pid, CAST(isodow(make_timestamp(ts_ms * 1000)) - 1 AS INTEGER) AS dow, CAST(hour(make_timestamp(ts_ms * 1000)) AS INTEGER) AS hour, CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day FROM t), d AS (SELECT vehicle_pid, dow, count(DISTINCT day) AS days FROM q GROUP BY 1, 2), h AS (SELECT vehicle_pid, dow, hour, count(DISTINCT day) AS active FROM q GROUP BY 1, 2, 3) SELECT vehicle_pid, dow, hour, active, days, active / days AS probability, active / days <= 0.05 AS rare FROM h JOIN d USING (vehicle_pid, dow)"


_profile_sql()

# windows -----------------------------------------------------------------------------------------


@query("w_delta_speed", f", {DELTAS} SELECT event_id, dt_ms, {r('accel')} AS accel_ms2 FROM a")
def w_delta_speed(spark, sf):
    return safety.deltas(telemetry(spark, sf)).select("event_id", "dt_ms", rc(F.col("accel_ms2")).alias("accel_ms2"))


@query("w_delta_heading", f", {DELTAS} SELECT event_id, {r('rate')} AS turn_deg_s FROM a")
def w_delta_heading(spark, sf):
    return safety.deltas(telemetry(spark, sf)).select("event_id", rc(F.col("turn_deg_s")).alias("turn_deg_s"))


@query("w_delta_odo", f", p AS (SELECT event_id, lat_e6, lon_e6, lag(lat_e6) OVER w AS a, lag(lon_e6) OVER w AS b FROM t WINDOW w AS (PARTITION BY vehicle_pid ORDER BY ts_ms, seq)), s AS (SELECT event_id, {haversine_sql('a / 1e6', 'b / 1e6', LAT, LON)} AS m FROM p) SELECT event_id, CASE WHEN m > 2 AND m < 2000 THEN {r('m', 2)} ELSE 0.0 END AS step_m FROM s")
def w_delta_odo(spark, sf):
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")
    d = haversine(F.lag("lat_e6").over(w) / 1e6, F.lag("lon_e6").over(w) / 1e6, F.expr(LAT), F.expr(LON))
    return telemetry(spark, sf).withColumn("m", d).select("event_id", F.when((F.col("m") > 2) & (F.col("m") < 2000), rc(F.col("m"), 2)).otherwise(0.0).alias("step_m"))


CHARGE = ISLANDS.format(cond="charge_state = 'CHARGING' OR charge_kw > 0.05") + f""",
cs AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY vehicle_pid, island ORDER BY ts_ms, seq) AS dt FROM i WHERE inside),
cr AS (SELECT vehicle_pid, tenant_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, arg_max(coalesce(next_ms, -1), (ts_ms, seq)) AS next_ms, arg_min(soc_pct, (ts_ms, seq)) AS s0, arg_max(soc_pct, (ts_ms, seq)) AS s1, sum(CASE WHEN dt > 0 AND dt < 300000 THEN charge_kw * dt / 3600000.0 ELSE 0.0 END) AS kwh, max(CASE WHEN dt IS NULL OR (dt > 0 AND dt < 300000) THEN charge_kw END) AS peak FROM cs GROUP BY vehicle_pid, tenant_id, island),
ce AS (SELECT *, CASE WHEN last_ms > start_ms THEN last_ms ELSE next_ms END AS end_ms FROM cr WHERE next_ms >= 0),
se AS (SELECT vehicle_pid, tenant_id, start_ms, end_ms, {r('s0', 1)} AS start_soc_pct, {r('s1', 1)} AS end_soc_pct, {r('kwh')} AS energy_kwh, {r('peak', 1)} AS peak_power_kw, {r('kwh * 0.22', 2)} AS baseline_cost, {r('kwh * 0.12', 2)} AS smart_cost, CASE WHEN s1 - s0 >= 15 AND kwh > 0.5 THEN {r('least(100.0, greatest(50.0, kwh * 0.92 / ((s1 - s0) / 100.0 * 60.0) * 100.0))', 1)} END AS soh_estimate FROM ce WHERE end_ms - start_ms >= 30000)"""


@query("st_charging", f", {CHARGE} SELECT * FROM se")
def st_charging(spark, sf):
    return episodes.charging_sessions(telemetry(spark, sf)).drop("session_id", "avg_power_kw", "cost_saving")


@query("w_islands_charge", f", {CHARGE} SELECT vehicle_pid, count(*) AS sessions, {r('sum(energy_kwh)', 4)} AS kwh FROM se GROUP BY 1")
def w_islands_charge(spark, sf):
    return episodes.charging_sessions(telemetry(spark, sf)).groupBy("vehicle_pid").agg(F.count("*").alias("sessions"), rc(F.sum("energy_kwh"), 4).alias("kwh"))


@query("soh_java", f", {CHARGE} SELECT vehicle_pid, start_ms, soh_estimate FROM se WHERE soh_estimate IS NOT NULL")
def soh_java(spark, sf):
    return episodes.charging_sessions(telemetry(spark, sf)).where("soh_estimate is not null").select("vehicle_pid", "start_ms", "soh_estimate")


@query("agg_soh_median", f", {CHARGE} SELECT vehicle_pid, median(soh_estimate) AS soh_median, count(*) AS sessions FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_pid ORDER BY start_ms DESC) AS n FROM se WHERE soh_estimate IS NOT NULL) WHERE n <= 5 GROUP BY 1")
def agg_soh_median(spark, sf):
    return episodes.median_soh(episodes.charging_sessions(telemetry(spark, sf)))


@query("cost_session", f", {CHARGE} SELECT vehicle_pid, start_ms, baseline_cost, smart_cost FROM se")
def cost_session(spark, sf):
    return episodes.charging_sessions(telemetry(spark, sf)).select("vehicle_pid", "start_ms", "baseline_cost", "smart_cost")


@query("cost_idle", f", {IDLE} SELECT vehicle_pid, start_ms, cost, avoidable_cost, co2_kg FROM ep")
def cost_idle(spark, sf):
    return episodes.idle_episodes(telemetry(spark, sf)).select("vehicle_pid", "start_ms", "cost", "avoidable_cost", "co2_kg")


@query("w_gap_detect", "SELECT event_id, gap FROM (SELECT event_id, ts_ms - lag(ts_ms) OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS gap FROM t) WHERE gap >= 300000")
def w_gap_detect(spark, sf):
    w = Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")
    return telemetry(spark, sf).select("event_id", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap")).where("gap >= 300000")


@query("w_latest_per_key", f", {LATEST} SELECT vehicle_pid, event_id, ts_ms FROM l")
def w_latest_per_key(spark, sf):
    return live.latest(telemetry(spark, sf)).select("vehicle_pid", "event_id", "ts_ms")


@query("w_rank_leaderboard", ", s AS (SELECT vehicle_pid, CAST(sum(k) AS BIGINT) AS score FROM t GROUP BY 1) SELECT vehicle_pid, score, dense_rank() OVER (ORDER BY score DESC) AS rank FROM s")
def w_rank_leaderboard(spark, sf):
    s = telemetry(spark, sf).groupBy("vehicle_pid").agg(F.sum("k").alias("score"))
    return paging.leaderboard(s, "score", "vehicle_pid").select("vehicle_pid", "score", F.col("rank").cast("bigint").alias("rank"))


@query("w_score_7d_drop", """, d AS (SELECT vehicle_pid, ts_ms // 600000 AS day, avg(k) AS score FROM t GROUP BY 1, 2), j AS (SELECT d.vehicle_pid, d.day, d.score, e.score AS before FROM d ASOF JOIN d AS e ON d.vehicle_pid = e.vehicle_pid AND d.day - 1 >= e.day) SELECT vehicle_pid, day, """ + r("before - score") + """ AS lost FROM j WHERE before - score >= 10""")
def w_score_7d_drop(spark, sf):
    d = telemetry(spark, sf).groupBy("vehicle_pid", F.floor(F.col("ts_ms") / 600_000).alias("day")).agg(F.avg("k").alias("score"))
    w = Window.partitionBy("vehicle_pid").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return d.withColumn("before", F.last("score").over(w)).where("before - score >= 10").select("vehicle_pid", "day", rc(F.col("before") - F.col("score")).alias("lost"))


@query("w_sliding_buckets", f"SELECT event_id, count(*) OVER w AS n, {r('sum(speed_kmh) OVER w')} AS speed_sum, max(speed_kmh) OVER w AS speed_max FROM t WINDOW w AS (PARTITION BY vehicle_pid ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)")
def w_sliding_buckets(spark, sf):
    return rollups.sliding(telemetry(spark, sf)).select(F.col("seq").alias("event_id"), "n", rc(F.col("speed_sum")).alias("speed_sum"), "speed_max")


# sorting and sets --------------------------------------------------------------------------------


@query("s_keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25", telemetry=False)
def s_keyset_page(spark, sf):
    import datetime

    return paging.keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 25, (datetime.datetime(1996, 6, 1), 5000))


@query("s_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100", telemetry=False)
def s_offset_page(spark, sf):
    return paging.offset_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 50, 100)


@query("s_alerts_open", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 40", telemetry=False)
def s_alerts_open(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", F.col("o_orderdate").desc(), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@query("s_topk_chargers", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3", telemetry=False)
def s_topk_chargers(spark, sf):
    return paging.top_per_group(table(spark, sf, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@query("s_reorder", "SELECT vehicle_pid, event_id, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS place FROM t")
def s_reorder(spark, sf):
    return telemetry(spark, sf).select("vehicle_pid", "event_id", F.row_number().over(Window.partitionBy("vehicle_pid").orderBy("ts_ms", "seq")).cast("bigint").alias("place"))


@query("s_archive_sort", "SELECT tenant_id, count(*) AS rows, 0 AS out_of_order FROM t GROUP BY 1")
def s_archive_sort(spark, sf):
    t = telemetry(spark, sf).select("tenant_id", "vehicle_pid", "ts_ms").repartition("tenant_id").sortWithinPartitions("tenant_id", "vehicle_pid", "ts_ms")
    w = Window.partitionBy("tenant_id").orderBy("place")
    t = t.withColumn("place", F.monotonically_increasing_id())
    bad = (F.lag("vehicle_pid").over(w) > F.col("vehicle_pid")) | ((F.lag("vehicle_pid").over(w) == F.col("vehicle_pid")) & (F.lag("ts_ms").over(w) > F.col("ts_ms")))
    return t.withColumn("bad", F.when(bad, 1).otherwise(0)).groupBy("tenant_id").agg(F.count("*").alias("rows"), F.sum("bad").alias("out_of_order"))


@query("s_audit_tail", "SELECT event_id FROM t WHERE tenant_id = 1 ORDER BY event_id DESC LIMIT 30")
def s_audit_tail(spark, sf):
    return telemetry(spark, sf).where("tenant_id = 1").orderBy(F.col("event_id").desc()).limit(30).select("event_id")


@query("s_slack_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY 32 - ceil(greatest(0.001, 10 + abs(c_acctbal) / 400 - 10) / (least(22.0, 11.0) * 0.25 * 0.92)), c_custkey) AS place FROM customer", telemetry=False)
def s_slack_order(spark, sf):
    from motorcade.operators.algorithms import slack

    s = slack(F.lit(10.0), 10 + F.abs("c_acctbal") / 400, F.lit(22.0), F.lit(11.0), F.lit(32))
    w = Window.partitionBy("c_nationkey").orderBy("s", "c_custkey")
    return table(spark, sf, "customer").withColumn("s", s).select("c_custkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("u_clean_late", "SELECT k % 7 = 0 AS late, count(*) AS n FROM t GROUP BY 1")
def u_clean_late(spark, sf):
    t = telemetry(spark, sf)
    both = t.where("k % 7 <> 0").withColumn("late", F.lit(False)).unionByName(t.where("k % 7 = 0").withColumn("late", F.lit(True)))
    return both.groupBy("late").agg(F.count("*").alias("n"))


@query("u_ledger_union", "SELECT DISTINCT vehicle_pid FROM t WHERE k < 3 UNION SELECT vehicle_pid FROM t WHERE k > 96")
def u_ledger_union(spark, sf):
    v = telemetry(spark, sf)
    return v.where("k < 3").select("vehicle_pid").union(v.where("k > 96").select("vehicle_pid")).distinct()


@query("u_ledger_except", "SELECT event_id FROM t EXCEPT SELECT event_id FROM t WHERE event_id % 13 <> 0")
def u_ledger_except(spark, sf):
    t = telemetry(spark, sf).select("event_id")
    return t.subtract(t.where("event_id % 13 <> 0"))


@query("u_dedupe_distinct", "SELECT event_id, vehicle_pid FROM t")
def u_dedupe_distinct(spark, sf):
    t = telemetry(spark, sf).select("event_id", "vehicle_pid")
    return t.unionByName(t.where("event_id % 20 = 0")).dropDuplicates(["event_id"])


@query("u_intersect", "SELECT vehicle_pid FROM t WHERE k < 50 INTERSECT SELECT vehicle_pid FROM t WHERE k >= 50")
def u_intersect(spark, sf):
    t = telemetry(spark, sf)
    return t.where("k < 50").select("vehicle_pid").intersect(t.where("k >= 50").select("vehicle_pid"))


@query("u_union_find")
def u_union_find(spark, sf):
    """Busy map cells joined over touching sides; tests compare with a plain union-find."""
    from motorcade.functions.geo import geohash

    cells = telemetry(spark, sf).groupBy(geohash(F.expr(LAT), F.expr(LON), 7).alias("cell")).agg(F.count("*").alias("n")).where("n >= 2").select("cell")
    return components(adjacent_cells(cells, 7))


# sinks -------------------------------------------------------------------------------------------


@query("sink_tsv_format", "SELECT event_id, CAST(event_id AS VARCHAR) || chr(9) || vehicle_pid || chr(9) || CASE WHEN code IS NULL THEN '[]' ELSE '[''' || code || ''']' END || chr(9) || CASE WHEN ignition THEN '1' ELSE '0' END || chr(9) || '\\N' AS line FROM t")
def sink_tsv_format(spark, sf):
    t = telemetry(spark, sf).select("event_id", "vehicle_pid", "dtc", "ignition", "rpm")
    return t.select("event_id", writers.tsv_line(t).alias("line"))


@query("sink_pg_trip_upsert", "SELECT vehicle_pid, max(event_id) AS event_id FROM t GROUP BY 1")
def sink_pg_trip_upsert(spark, sf):
    t = telemetry(spark, sf).select("vehicle_pid", "event_id")
    return writers.upserted(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), ["vehicle_pid"], "event_id")


@query("sink_pg_alert_insert", ", a AS (SELECT vehicle_pid, min(event_id) FILTER (event_id < 5000) AS old, min(event_id) AS new FROM t GROUP BY 1) SELECT vehicle_pid, coalesce(old, new) AS event_id FROM a")
def sink_pg_alert_insert(spark, sf):
    t = telemetry(spark, sf).select("vehicle_pid", "event_id")
    old = t.where("event_id < 5000").groupBy("vehicle_pid").agg(F.min("event_id").alias("event_id"))
    return writers.inserted(old, t.where("event_id >= 5000"), ["vehicle_pid"], "event_id")


@query("sink_mongo_upsert", ", o AS (SELECT vehicle_pid, min(ts_ms) AS created, count(*) AS n FROM t WHERE k < 50 GROUP BY 1), w AS (SELECT vehicle_pid, max(ts_ms) AS created, count(*) AS n FROM t WHERE k >= 50 GROUP BY 1) SELECT vehicle_pid, coalesce(o.created, w.created) AS created, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (vehicle_pid)")
def sink_mongo_upsert(spark, sf):
    t = telemetry(spark, sf)
    old = t.where("k < 50").groupBy("vehicle_pid").agg(F.min("ts_ms").alias("created"), F.count("*").alias("n"))
    new = t.where("k >= 50").groupBy("vehicle_pid").agg(F.max("ts_ms").alias("created"), F.count("*").alias("n"))
    return writers.documents_upserted(old, new, "vehicle_pid", "created")


@query("sink_dlq", """SELECT count(*) AS n, reason_code FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'MALFORMED' WHEN event_id % 51 = 0 AND k % 6 <> 3 THEN 'UNKNOWN_OEM' WHEN CAST(vehicle_pid AS INTEGER) % 11 = 0 THEN 'UNKNOWN_VEHICLE' END AS reason_code FROM t) WHERE reason_code IS NOT NULL GROUP BY 2""")
def sink_dlq(spark, sf):
    from motorcade.operators.normalize import normalize, rejected
    from motorcade.plans.scalars import payloads, registry

    dead = writers.dead_letters(rejected(normalize(payloads(spark, sf), registry(spark, sf))))
    return dead.groupBy("reason_code").agg(F.count("*").alias("n"))

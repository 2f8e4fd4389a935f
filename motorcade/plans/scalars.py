"""Queries of sources, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorcade.functions import codes, geo, ids, privacy
from motorcade.operators import mapping, normalize
from motorcade.plans.base import query
from motorcade.plans.telemetry import geohash_sql, haversine_sql, r, rc, table, telemetry, uuid3_sql

VIN16 = "concat('1HGCM826', 'A', lpad(vehicle_pid, 7, '0'))"
LAT, LON = "lat_e6 / 1e6", "lon_e6 / 1e6"
KEY = "recipient-7:2024-01"


def _vin_sql(body: str) -> str:
    """DuckDB: check digit of a VIN whose 16 other characters are given."""
    raw = f"(substr({body},1,8) || '0' || substr({body},9,8))"
    total = " + ".join(f"CAST(substr(translate({raw}, '{codes.VIN_LETTERS}', '{codes.VIN_NUMBERS}'), {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(codes.VIN_WEIGHTS))
    return f"(CASE WHEN ({total}) % 11 = 10 THEN 'X' ELSE CAST(({total}) % 11 AS VARCHAR) END)"


def with_vin(t):
    return t.withColumn("vin", codes.vin_build(F.concat(F.lit("1HGCM826A"), F.lpad("vehicle_pid", 7, "0"))))


def registry(spark, sf):
    """Vehicles of all users whose number isn't a multiple of 11, so that some are unknown."""
    v = telemetry(spark, sf).select("vehicle_pid", "tenant_id").distinct()
    return with_vin(v).where(F.col("vehicle_pid").cast("int") % 11 != 0)


def payloads(spark, sf):
    """A payload per sample, its format by k; every 50th is broken and every 51st has no manufacturer."""
    t = with_vin(telemetry(spark, sf))
    kinds = [("A", 1), ("B", 1), ("C", 1), ("D", 1), ("E", 1), ("E", 2)]
    raw, oem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (o, v) in enumerate(kinds):
        raw = F.when(F.col("k") % 6 == i, normalize.encode(t, o, v)).otherwise(raw)
        oem = F.when(F.col("k") % 6 == i, F.lit(o)).otherwise(oem)
    broken = F.col("event_id") % 50 == 0
    return t.select("event_id", "ts_ms", F.when(broken, F.lit("{broken")).otherwise(raw).alias("raw"), F.when((F.col("event_id") % 51 == 0) & ~broken & (F.col("k") % 6 != 3), F.lit("Z")).otherwise(oem).alias("oem"), F.lit(None).cast("int").alias("schema_ver"), F.col("ts_ms").alias("recv_ms"))


@query("src_http_batch", ", b AS (SELECT event_id // 20 AS batch, count(*) AS n FROM t GROUP BY 1) SELECT batch, n AS lines, 0 AS first_line, n - 1 AS last_line FROM b")
def src_http_batch(spark, sf):
    t = telemetry(spark, sf).select(F.floor(F.col("event_id") / 20).alias("batch"), F.to_json(F.struct("event_id", "k")).alias("j"))
    bodies = t.groupBy("batch").agg(F.concat_ws("\r\n", F.collect_list("j"), F.lit(""), F.lit("  ")).alias("body"))
    return normalize.split_ndjson(bodies).groupBy("batch").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"), F.max("line").cast("bigint").alias("last_line"))


@query("src_key_extract", f""", v AS (SELECT *, '1HGCM826' || {_vin_sql("('1HGCM826A' || lpad(vehicle_pid, 7, '0'))")} || 'A' || lpad(vehicle_pid, 7, '0') AS vin FROM t WHERE event_id % 50 <> 0)
SELECT event_id, vin AS key FROM v""")
def src_key_extract(spark, sf):
    return payloads(spark, sf).where("event_id % 50 <> 0").select("event_id", normalize.extract_key(F.col("raw")).alias("key"))


@query("src_mapping_json", "SELECT * FROM (VALUES ('A', 1, 'json', 11), ('B', 1, 'json', 11), ('C', 1, 'signal_list', 8), ('D', 1, 'delimited', 8), ('E', 1, 'json', 5), ('E', 2, 'json', 8)) AS x(oem, schema_ver, format, fields)")
def src_mapping_json(spark, sf):
    f = mapping.Registry().frame(spark)
    return f.select("oem", "schema_ver", "format", F.size(F.from_json(F.get_json_object("config", "$.fields"), "map<string,string>")).alias("fields"))


@query("norm_pipeline", """SELECT event_id,
  CASE WHEN event_id % 50 = 0 AND k % 6 <> 3 THEN 'MALFORMED' WHEN event_id % 50 = 0 THEN 'MALFORMED' WHEN event_id % 51 = 0 AND k % 6 <> 3 THEN 'UNKNOWN_OEM' WHEN CAST(vehicle_pid AS INTEGER) % 11 = 0 THEN 'UNKNOWN_VEHICLE' END AS reason_code,
  CASE WHEN event_id % 50 = 0 OR (event_id % 51 = 0 AND k % 6 <> 3) THEN NULL ELSE ts_ms END AS ts_event,
  CASE WHEN event_id % 50 = 0 OR (event_id % 51 = 0 AND k % 6 <> 3) THEN NULL WHEN k % 6 = 3 THEN CAST(floor(lat_e6 / 10.0 + 0.5) AS INTEGER) * 10 ELSE lat_e6 END AS lat_e6,
  CASE WHEN event_id % 50 = 0 OR (event_id % 51 = 0 AND k % 6 <> 3) OR k % 6 >= 2 THEN NULL ELSE heading_deg END AS heading_deg,
  CASE WHEN event_id % 50 = 0 OR (event_id % 51 = 0 AND k % 6 <> 3) OR k % 6 IN (2, 4, 5) THEN NULL ELSE ignition END AS ignition,
  CASE WHEN k % 6 NOT IN (0, 1, 3) OR (event_id % 50 <> 0 AND event_id % 51 = 0 AND k % 6 <> 3) THEN NULL WHEN event_id % 50 = 0 OR code IS NULL THEN '' ELSE code END AS dtc,
  CASE WHEN event_id % 50 = 0 OR (event_id % 51 = 0 AND k % 6 <> 3) OR k % 6 <> 5 THEN NULL ELSE charge_state END AS charge_state_v2
FROM t""")
def norm_pipeline(spark, sf):
    p = payloads(spark, sf).withColumnRenamed("event_id", "src_id")
    n = normalize.normalize(p, registry(spark, sf))
    state = F.when((F.col("oem") == "E") & (F.col("schema_ver") == 2), F.when(F.col("charge_state") == "CHARGING", "CHARGING").otherwise("NONE"))
    return n.select(F.col("src_id").alias("event_id"), "reason_code", "ts_event", "lat_e6", "heading_deg", "ignition", F.array_join("dtc", ",").alias("dtc"), state.alias("charge_state_v2"))


@query("norm_mapping_lookup", "SELECT * FROM (VALUES ('A', 7, 1), ('E', 1, 1), ('E', 2, 2), ('E', 9, 2)) AS x(oem, wanted, used)")
def norm_mapping_lookup(spark, sf):
    m = mapping.Registry()
    return spark.createDataFrame([(o, v, m.lookup(o, v)["schema_ver"]) for o, v in (("A", 7), ("E", 1), ("E", 2), ("E", 9))], "oem string, wanted int, used int")


@query("norm_shadow", """, m AS (SELECT * FROM t WHERE event_id % 50 <> 0 AND k % 6 = 0)
SELECT 'speed_kmh' AS field, (SELECT count(*) FROM m WHERE speed_kmh <> 0) AS differences UNION ALL SELECT 'heading_deg', (SELECT count(*) FROM m)""")
def norm_shadow(spark, sf):
    a = mapping.BUILT_IN[0]
    fields = {k: v for k, v in a["fields"].items() if k != "heading_deg"} | {"speed_kmh": {"source": "speedKph", "transform": "scale", "factor": 1.6}}
    rows = payloads(spark, sf).where("event_id % 50 <> 0 and raw like '{\"vehicleId%'")
    return normalize.shadow_differences(rows, a, a | {"schema_ver": 2, "fields": fields}).where("differences > 0")


@query("tf_transforms", f"""SELECT event_id, CAST(floor(lat_e6 / 1e6 * 1e6 + 0.5) AS INTEGER) AS scaled_e6, {r('speed_kmh * 1.609344 + 1.5', 4)} AS scaled, ts_ms AS iso_ms, CAST(floor((ts_ms / 1000.0) * 1000 + 0.5) AS BIGINT) AS epoch_ms,
  greatest(k - 50, 0) * 1.0 AS charge_kw, CASE WHEN 50 - k < 0 THEN 'CHARGING' ELSE 'NONE' END AS charge_state, CASE WHEN k % 2 = 0 THEN 'HARSH_BRAKE' END AS evt, CAST(len(list_filter(string_split('P0301; ;P0' || k, ';'), lambda x: trim(x) <> '')) AS INTEGER) AS parts, k * 2.0 + 1.0 AS item FROM t""")
def tf_transforms(spark, sf):
    t = telemetry(spark, sf)
    v = lambda name, rule, text: mapping._value(name, rule, text)
    s = lambda c: c.cast("string")
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.select(
        "event_id",
        v("lat_e6", mapping.E6, s(F.col("lat_e6") / 1e6)).alias("scaled_e6"),
        rc(v("speed_kmh", {"transform": "scale", "factor": 1.609344, "offset": 1.5}, s(F.col("speed_kmh"))), 4).alias("scaled"),
        v("ts_event", {"transform": "iso8601_to_ms"}, iso).alias("iso_ms"),
        v("ts_event", {"transform": "epoch_s_to_ms"}, s(F.col("ts_ms") / 1000.0)).alias("epoch_ms"),
        v("charge_kw", {"transform": "negative_to_charge_kw"}, s(50 - F.col("k"))).alias("charge_kw"),
        v("charge_state", {"transform": "negative_to_charge_state"}, s(50 - F.col("k"))).alias("charge_state"),
        v("evt", {"transform": "enum_map", "mapping": {"HB": "HARSH_BRAKE"}}, F.when(F.col("k") % 2 == 0, F.lit('["HB","HA"]')).otherwise(F.lit("none"))).alias("evt"),
        F.size(v("dtc", {"transform": "split_list", "separator": ";"}, F.concat(F.lit("P0301; ;P0"), s(F.col("k"))))).alias("parts"),
        v("odo_km", {"transform": "array_index", "index": 1, "factor": 2.0, "offset": 1.0}, F.concat(F.lit("[0,"), s(F.col("k")), F.lit("]"))).alias("item"),
    )


@query("val_vin", f""", v AS (SELECT DISTINCT vehicle_pid, '1HGCM826' || {_vin_sql("('1HGCM826A' || lpad(vehicle_pid, 7, '0'))")} || 'A' || lpad(vehicle_pid, 7, '0') AS vin FROM t)
SELECT vehicle_pid, vin, true AS valid, substr(vin, 9, 1) <> '0' AS altered_warns, false AS with_letter_o FROM v""")
def val_vin(spark, sf):
    v = with_vin(telemetry(spark, sf).select("vehicle_pid").distinct())
    altered = F.concat(F.substr("vin", F.lit(1), F.lit(8)), F.lit("0"), F.substr("vin", F.lit(10), F.lit(8)))
    bad = F.concat(F.lit("O"), F.substr("vin", F.lit(2), F.lit(16)))
    return v.select("vehicle_pid", "vin", codes.vin_valid(F.col("vin")).alias("valid"), (codes.vin_valid(altered, strict=False) & ~codes.vin_valid(altered)).alias("altered_warns"), codes.vin_wellformed(bad).alias("with_letter_o"))


@query("gen_vin", f""", v AS (SELECT DISTINCT vehicle_pid FROM t) SELECT vehicle_pid, {_vin_sql("('1HGCM826A' || lpad(vehicle_pid, 7, '0'))")} AS check_digit FROM v""")
def gen_vin(spark, sf):
    return with_vin(telemetry(spark, sf).select("vehicle_pid").distinct()).select("vehicle_pid", codes.vin_check_digit(F.col("vin")).alias("check_digit"))


@query("val_dtc", "SELECT event_id, CASE WHEN code IS NULL THEN 'P0420' WHEN code = 'P0420' THEN 'P0420' ELSE code || ',P0420' END AS codes FROM t")
def val_dtc(spark, sf):
    noisy = F.concat(F.col("dtc"), F.array(F.lit(" p0420 "), F.lit("X0000"), F.lit("P9999"), F.lit("P0420")))
    return telemetry(spark, sf).select("event_id", F.array_join(codes.dtc_clean(noisy), ",").alias("codes"))


@query("dtc_parse", """SELECT code, CASE substr(code, 1, 1) WHEN 'P' THEN 'POWERTRAIN' WHEN 'C' THEN 'CHASSIS' WHEN 'U' THEN 'NETWORK' END AS system, substr(code, 2, 1) IN ('0', '1') AS generic,
  CASE code WHEN 'P0301' THEN 'HIGH' WHEN 'P0420' THEN 'LOW' ELSE 'MEDIUM' END AS severity, count(*) AS n FROM t WHERE code IS NOT NULL GROUP BY 1, 2, 3, 4""")
def dtc_parse(spark, sf):
    return telemetry(spark, sf).select(F.explode(codes.dtc_parsed(F.col("dtc"))).alias("d")).groupBy("d.code", "d.system", "d.generic", "d.severity").agg(F.count("*").alias("n"))


@query("flag_clock_skew", "SELECT event_id, CASE WHEN k < 10 OR k > 90 THEN 16 ELSE 0 END AS quality FROM t")
def flag_clock_skew(spark, sf):
    t = telemetry(spark, sf).withColumn("recv_ms", F.col("ts_ms") + F.when(F.col("k") < 10, -normalize.AHEAD_MS - 1).when(F.col("k") > 90, normalize.BEHIND_MS + 1).otherwise(0))
    skew = (F.col("ts_ms") > F.col("recv_ms") + normalize.AHEAD_MS) | (F.col("ts_ms") < F.col("recv_ms") - normalize.BEHIND_MS)
    return t.select("event_id", F.when(skew, 16).otherwise(0).alias("quality"))


@query("id_event", "SELECT event_id, substr(sha256(vehicle_pid || ':' || ts_ms || ':' || seq), 1, 16) AS id FROM t")
def id_event(spark, sf):
    return telemetry(spark, sf).select("event_id", ids.event_id(F.col("vehicle_pid"), F.col("ts_ms"), F.col("seq"), F.lit("")).alias("id"))


@query("id_uuid3", f"SELECT event_id, {uuid3_sql("vehicle_pid || ':' || ts_ms")} AS id FROM t")
def id_uuid3(spark, sf):
    return telemetry(spark, sf).select("event_id", ids.uuid3(F.concat_ws(":", "vehicle_pid", F.col("ts_ms").cast("string"))).alias("id"))


@query("id_to_u64", "SELECT event_id, CAST(CAST(('0x' || substr(md5(vehicle_pid), 1, 16)) AS UBIGINT) AS VARCHAR) AS from_hex, CAST(event_id AS VARCHAR) AS from_digits FROM t")
def id_to_u64(spark, sf):
    return telemetry(spark, sf).select("event_id", ids.to_u64(F.substr(F.md5("vehicle_pid"), F.lit(1), F.lit(16))).cast("string").alias("from_hex"), ids.to_u64(F.col("event_id").cast("string")).cast("string").alias("from_digits"))


@query("id_event_py")
def id_event_py(spark, sf):
    """The content hash has no counterpart in the other engine; rows and distinctness are tested."""
    return telemetry(spark, sf).select("event_id", ids.content_id(F.col("vehicle_pid"), F.col("ts_ms"), F.col("seq")).alias("id"))


@query("f_vehicles_filter", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 0 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50", telemetry=False)
def f_vehicles_filter(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_nationkey") == 0) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_nationkey", "c_mktsegment").orderBy("c_custkey").limit(50)


@query("f_tenant_isolation", "SELECT event_id, tenant_id FROM t WHERE tenant_id = 3")
def f_tenant_isolation(spark, sf):
    return telemetry(spark, sf).where("tenant_id = 3").select("event_id", "tenant_id")


@query("f_time_range", "SELECT event_id, ts_ms FROM t WHERE tenant_id = 2 AND vehicle_pid = '7' AND ts_ms BETWEEN 1704067200000 AND 1704069600000")
def f_time_range(spark, sf):
    return telemetry(spark, sf).where((F.col("tenant_id") == 2) & (F.col("vehicle_pid") == "7") & F.col("ts_ms").between(1704067200000, 1704069600000)).select("event_id", "ts_ms")


@query("f_masking", "SELECT event_id, CASE k % 4 WHEN 0 THEN round_even(lat_e6 / 1e6 * 1e6, 0) / 1e6 WHEN 1 THEN 0.0 WHEN 2 THEN round_even(lat_e6 / 1e6 * 1e3, 0) / 1e3 ELSE round_even(lat_e6 / 1e6 * 1e2, 0) / 1e2 END AS lat FROM t")
def f_masking(spark, sf):
    role = F.element_at(F.array(F.lit("FLEET_MANAGER"), F.lit("AUDITOR"), F.lit("FINANCE_ANALYST"), F.lit("PARTNER_RECIPIENT")), F.col("k") % 4 + 1)
    return telemetry(spark, sf).select("event_id", privacy.masked_position(F.expr(LAT), F.expr(LON), F.array(role))["lat"].alias("lat"))


@query("p_mask", "SELECT event_id, round_even(lat_e6 / 1e6 * 1000.0, 0) / 1000.0 AS lat3, round_even(lon_e6 / 1e6 * 10.0, 0) / 10.0 AS lon1 FROM t")
def p_mask(spark, sf):
    return telemetry(spark, sf).select("event_id", privacy.mask(F.expr(LAT), 3).alias("lat3"), privacy.mask(F.expr(LON), 1).alias("lon1"))


@query("geo_haversine", f"SELECT event_id, {r(haversine_sql(LAT, LON, '13.0827', '80.2707'), 3)} AS m, {r(haversine_sql(LAT, LON, '13.0827', '80.2707', 6371.0088), 6)} AS km FROM t")
def geo_haversine(spark, sf):
    lat, lon, a, b = F.expr(LAT), F.expr(LON), F.lit(13.0827), F.lit(80.2707)
    return telemetry(spark, sf).select("event_id", rc(geo.haversine(lat, lon, a, b), 3).alias("m"), rc(geo.haversine(lat, lon, a, b, geo.EARTH_KM), 6).alias("km"))


@query("geo_encode", f"SELECT event_id, {geohash_sql(LAT, LON, 7)} AS gh7, {geohash_sql('-' + LAT, '-(' + LON + ')', 5)} AS gh5 FROM t")
def geo_encode(spark, sf):
    lat, lon = F.expr(LAT), F.expr(LON)
    return telemetry(spark, sf).select("event_id", geo.geohash(lat, lon, 7).alias("gh7"), geo.geohash(-lat, -lon, 5).alias("gh5"))


@query("geo_decode", f"""SELECT event_id, {r('(floor((lat_e6 / 1e6 + 90.0) / 180.0 * 131072) + 0.5) * 180.0 / 131072 - 90.0', 7)} AS lat, {r('(floor((lon_e6 / 1e6 + 180.0) / 360.0 * 262144) + 0.5) * 360.0 / 262144 - 180.0', 7)} AS lon FROM t""")
def geo_decode(spark, sf):
    d = geo.geohash_decode(geo.geohash(F.expr(LAT), F.expr(LON), 7))
    return telemetry(spark, sf).withColumn("d", d).select("event_id", rc(F.col("d.lat"), 7).alias("lat"), rc(F.col("d.lon"), 7).alias("lon"))


def _neighbours_sql() -> str:
    y, x = "floor((lat_e6 / 1e6 + 90.0) / 180.0 * 32768)", "floor((lon_e6 / 1e6 + 180.0) / 360.0 * 32768)"
    near = [geohash_sql(f"(({y} + {dy} + 0.5) * 180.0 / 32768 - 90.0)", f"(({x} + {dx} + 0.5) * 360.0 / 32768 - 180.0)", 6) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    return f"SELECT event_id, array_to_string(list_sort([{', '.join(near)}]), ',') AS near FROM t"


def _neighbours(t):
    return t.select("event_id", F.array_join(geo.geohash_neighbours(geo.geohash(F.expr(LAT), F.expr(LON), 6), 6), ",").alias("near"))


@query("geo_neighbors", _neighbours_sql())
def geo_neighbors(spark, sf):
    return _neighbours(telemetry(spark, sf))


@query("geo_cover_bbox", f""", g AS (SELECT y, x FROM range(CAST(floor((13.0 + 90.0) / 180.0 * 4096) AS BIGINT), CAST(floor((13.1 + 90.0) / 180.0 * 4096) AS BIGINT) + 1) a(y), range(CAST(floor((80.2 + 180.0) / 360.0 * 8192) AS BIGINT), CAST(floor((80.4 + 180.0) / 360.0 * 8192) AS BIGINT) + 1) b(x))
SELECT {geohash_sql('((y + 0.5) * 180.0 / 4096 - 90.0)', '((x + 0.5) * 360.0 / 8192 - 180.0)', 5)} AS cell FROM g""")
def geo_cover_bbox(spark, sf):
    return spark.range(1).select(F.explode(geo.cover_bbox(F.lit(13.0), F.lit(80.2), F.lit(13.1), F.lit(80.4), 5)).alias("cell"))


@query("geo_prefix_rollup", f"SELECT substr({geohash_sql(LAT, LON, 6)}, 1, 4) AS cell, count(*) AS n FROM t GROUP BY 1")
def geo_prefix_rollup(spark, sf):
    return telemetry(spark, sf).groupBy(F.substr(geo.geohash(F.expr(LAT), F.expr(LON), 6), F.lit(1), F.lit(4)).alias("cell")).agg(F.count("*").alias("n"))


@query("geo_zoom_precision", "SELECT CAST(z AS INTEGER) AS zoom, CASE WHEN z <= 6 THEN 3 WHEN z <= 9 THEN 4 WHEN z <= 12 THEN 5 ELSE 6 END AS precision FROM range(0, 20) x(z)", telemetry=False)
def geo_zoom_precision(spark, sf):
    return spark.range(20).select(F.col("id").cast("int").alias("zoom"), geo.zoom_precision(F.col("id")).alias("precision"))


@query("geo_in_circle", f"SELECT event_id, {haversine_sql(LAT, LON, '13.02', '80.25')} <= 3000 AS inside FROM t")
def geo_in_circle(spark, sf):
    return telemetry(spark, sf).select("event_id", geo.in_circle(F.expr(LAT), F.expr(LON), F.lit(13.02), F.lit(80.25), F.lit(3000.0)).alias("inside"))


RING = [(13.0, 80.2), (13.06, 80.2), (13.03, 80.25), (13.06, 80.3), (13.0, 80.3)]


def _ring_sql() -> str:
    parts = []
    for (a, b), (c, d) in zip(RING, RING[1:] + RING[:1], strict=True):
        parts.append(f"(CASE WHEN ({a} > {LAT}) <> ({c} > {LAT}) AND {LON} < ({d} - {b}) * ({LAT} - {a}) / (CASE WHEN {c} = {a} THEN 1 ELSE {c}::DOUBLE - {a} END) + {b} THEN 1 ELSE 0 END)")
    return f"SELECT event_id, ({' + '.join(parts)}) % 2 = 1 AS inside FROM t"


@query("geo_point_in_polygon", _ring_sql())
def geo_point_in_polygon(spark, sf):
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in RING])
    return telemetry(spark, sf).select("event_id", geo.in_polygon(F.expr(LAT), F.expr(LON), ring).alias("inside"))


@query("p_pseudonym")
def p_pseudonym(spark, sf):
    """HMAC and base32 have no counterpart in the other engine; tests compare with Python's own."""
    return telemetry(spark, sf).select("vehicle_pid").distinct().select("vehicle_pid", privacy.pseudonym(F.col("vehicle_pid"), KEY).alias("pseudonym"))


@query("p_laplace")
def p_laplace(spark, sf):
    t = telemetry(spark, sf).groupBy("tenant_id").agg(F.count("*").cast("double").alias("n"))
    return t.select("tenant_id", "n", rc(privacy.laplace(F.col("n"), 1.0, 0.5, privacy.uniform("secret", F.col("tenant_id"))), 6).alias("noisy"))

"""Queries of sources and sinks, which write a table and read it back, and of single transforms and access rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motorcade.functions import access
from motorcade.operators import episodes, lockstep, mapping, normalize, paging, safety
from motorcade.operators.trips import trips
from motorcade.plans.base import query
from motorcade.checkpoints import folder
from motorcade.plans.relational import LIVE
from motorcade.plans.scalars import payloads, registry
from motorcade.plans.stateful import SCORES, scores
from motorcade.plans.telemetry import T0_MS, r, rc, table, telemetry
from motorcade.sources import readers, writers

# sources -----------------------------------------------------------------------------------------


@query("src_csv_seed", "SELECT vehicle_pid, tenant_id FROM t WHERE CAST(vehicle_pid AS INTEGER) % 11 <> 0 GROUP BY 1, 2")
def src_csv_seed(spark, sf):
    path = folder(spark, "registry")
    registry(spark, sf).select("vin", "vehicle_pid", "tenant_id", F.lit(1).alias("fleet_id"), F.lit("EV").alias("powertrain")).write.csv(path, header=True)
    return readers.registry_csv(spark, path).select("vehicle_pid", "tenant_id")


@query("src_parquet_archive", "SELECT event_id FROM t WHERE tenant_id = 2 AND ts_ms // 3600000 % 24 = 0")
def src_parquet_archive(spark, sf):
    path = folder(spark, "archive")
    writers.archived(telemetry(spark, sf), path)
    return readers.archive(spark, path, tenant=2, hour=0).select("event_id")


@query("src_backpressure", "SELECT count(*) AS rows FROM t")
def src_backpressure(spark, sf):
    """A stream that reads a bounded number of files per micro-batch still reads all of them."""
    path, out = folder(spark, "backpressure"), folder(spark, "backpressure-out")
    t = telemetry(spark, sf).select("event_id", "vehicle_pid")
    t.repartition(6).write.parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)
    q = stream.writeStream.option("checkpointLocation", folder(spark, "offsets")).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema(t.schema).parquet(out).agg(F.count("*").alias("rows"))


@query("src_simulator", "SELECT CAST(v AS INTEGER) AS vehicle, count(*) AS samples, max(s) AS last_s FROM range(0, 50) a(v), range(0, 60) b(s) GROUP BY 1", telemetry=False)
def src_simulator(spark, sf):
    v = spark.range(50).select(F.col("id").cast("int").alias("vehicle"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("s"))
    speed = F.greatest(F.lit(0.0), 40 + 30 * F.sin((F.col("s") + F.col("vehicle")) / 9.0))
    return v.withColumn("speed_kmh", speed).groupBy("vehicle").agg(F.count("*").alias("samples"), F.max("s").cast("bigint").alias("last_s"))


# sinks -------------------------------------------------------------------------------------------


@query("sink_parquet_archive", "SELECT tenant_id AS tenant, CAST(ts_ms // 3600000 % 24 AS INTEGER) AS hour, count(*) AS rows FROM t GROUP BY 1, 2")
def sink_parquet_archive(spark, sf):
    path = folder(spark, "archive")
    writers.archived(telemetry(spark, sf), path)
    return spark.read.parquet(path).groupBy("tenant", "hour").agg(F.count("*").alias("rows"))


@query("sink_clickhouse_batch", "SELECT event_id % 3 AS batch_id, count(*) AS rows FROM t GROUP BY 1")
def sink_clickhouse_batch(spark, sf):
    """Three micro-batches, one of them written twice: each counts once."""
    path, t = folder(spark, "batches"), telemetry(spark, sf).select("event_id", "vehicle_pid")
    for b in (0, 1, 2, 1):
        writers.batch_written(t.where(F.col("event_id") % 3 == b), b, path)
    return spark.read.parquet(path).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count("*").alias("rows"))


@query("sink_fact_insert")
def sink_fact_insert(spark, sf):
    """Facts by kind, appended to one folder each."""
    t, path = telemetry(spark, sf), folder(spark, "facts")
    facts = {"trip": trips(t), "idle": episodes.idle_episodes(t), "charging": episodes.charging_sessions(t), "safety": safety.safety_events(t)}
    out = None
    for name, df in facts.items():
        df.write.mode("append").parquet(f"{path}/{name}")
        part = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("fact"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_redis_stream", f", {LIVE} SELECT vehicle_pid, CASE WHEN soc_pct <= 8 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM lv WHERE soc_pct <= 15")
def sink_redis_stream(spark, sf):
    """Alerts appended to a stream folder as JSON lines."""
    from motorcade.operators import live

    path = folder(spark, "alerts")
    a = live.live_state(telemetry(spark, sf)).where("soc_pct <= 15").select("vehicle_pid", F.when(F.col("soc_pct") <= 8, "CRITICAL").otherwise("HIGH").alias("severity"))
    a.write.mode("append").json(path)
    return spark.read.schema(a.schema).json(path)


@query("sink_topics", "SELECT k % 7 = 0 AS late, count(*) AS n FROM t GROUP BY 1")
def sink_topics(spark, sf):
    """Clean and late rows to a folder each."""
    path, t = folder(spark, "topics"), telemetry(spark, sf).select("event_id", "vehicle_pid", (F.col("k") % 7 == 0).alias("late"))
    t.write.partitionBy("late").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("late").cast("boolean").alias("late")).agg(F.count("*").alias("n"))


# transforms one by one ---------------------------------------------------------------------------


def _field(spark, sf, name: str, rule: dict, text):
    return telemetry(spark, sf).select("event_id", mapping._value(name, rule, text).alias("value"))


def _text(c):
    return c.cast("string")


@query("tf_direct", "SELECT event_id, code AS value FROM t")
def tf_direct(spark, sf):
    return _field(spark, sf, "evt", {"transform": "direct"}, F.get("dtc", F.lit(0)))


@query("tf_scale", f"SELECT event_id, {r('k * 0.1 + 2.0', 6)} AS value FROM t")
def tf_scale(spark, sf):
    f = _field(spark, sf, "odo_km", {"transform": "scale", "factor": 0.1, "offset": 2.0}, _text(F.col("k")))
    return f.withColumn("value", rc(F.col("value"), 6))


@query("tf_iso8601_to_ms", "SELECT event_id, ts_ms AS value FROM t")
def tf_iso8601_to_ms(spark, sf):
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _field(spark, sf, "ts_event", {"transform": "iso8601_to_ms"}, iso)


@query("tf_epoch_s_to_ms", "SELECT event_id, ts_ms AS value FROM t")
def tf_epoch_s_to_ms(spark, sf):
    return _field(spark, sf, "ts_event", {"transform": "epoch_s_to_ms"}, _text(F.col("ts_ms") / 1000.0))


@query("tf_enum_map", "SELECT event_id, CASE k % 3 WHEN 0 THEN 'HARSH_BRAKE' WHEN 1 THEN 'OVERSPEED' END AS value FROM t")
def tf_enum_map(spark, sf):
    key = F.element_at(F.array(F.lit("HB"), F.lit('["OS"]'), F.lit("??")), F.col("k") % 3 + 1)
    return _field(spark, sf, "evt", {"transform": "enum_map", "mapping": mapping.EVENTS}, key)


@query("tf_split_list", "SELECT event_id, 'P0' || k || ',B1' AS value FROM t")
def tf_split_list(spark, sf):
    f = _field(spark, sf, "dtc", {"transform": "split_list", "separator": ";"}, F.concat(F.lit(" P0"), _text(F.col("k")), F.lit(" ;; B1")))
    return f.withColumn("value", F.array_join("value", ","))


@query("tf_array_index", "SELECT event_id, k * 1000000 AS value FROM t")
def tf_array_index(spark, sf):
    return _field(spark, sf, "lat_e6", {"transform": "array_index", "index": 1, "factor": 1_000_000}, F.concat(F.lit("[1,"), _text(F.col("k")), F.lit("]")))


@query("tf_negative_to_charge_kw", "SELECT event_id, greatest(k - 50, 0)::DOUBLE AS value FROM t")
def tf_negative_to_charge_kw(spark, sf):
    return _field(spark, sf, "charge_kw", {"transform": "negative_to_charge_kw"}, _text(50 - F.col("k")))


@query("tf_negative_to_charge_state", "SELECT event_id, CASE WHEN k > 50 THEN 'CHARGING' ELSE 'NONE' END AS value FROM t")
def tf_negative_to_charge_state(spark, sf):
    return _field(spark, sf, "charge_state", {"transform": "negative_to_charge_state"}, _text(50 - F.col("k")))


@query("flag_clock_skew_norm", "SELECT event_id, CASE WHEN k < 10 OR k > 90 THEN 16 ELSE 0 END AS quality FROM t")
def flag_clock_skew_norm(spark, sf):
    from motorcade.plans.scalars import flag_clock_skew

    return flag_clock_skew(spark, sf)


@query("fmt_ts", "SELECT event_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.') || lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0') AS text FROM t")
def fmt_ts(spark, sf):
    return telemetry(spark, sf).select("event_id", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("text"))


# normalizer parts --------------------------------------------------------------------------------


@query("norm_detect_oem", "SELECT event_id, CASE k % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS oem, CASE WHEN k % 6 = 5 THEN 2 ELSE 1 END AS schema_ver FROM t WHERE event_id % 50 <> 0 AND event_id % 51 <> 0")
def norm_detect_oem(spark, sf):
    p = payloads(spark, sf).where("event_id % 50 <> 0 and event_id % 51 <> 0").withColumn("oem", F.lower(F.concat("oem", F.lit(" "))))
    return normalize.detected(p).select("event_id", "oem", "schema_ver")


def _mapped(spark, sf, index: int, kind: int, *fields):
    """Fields of payloads of one kind through one mapping."""
    m = mapping.BUILT_IN[index]
    rows = payloads(spark, sf).where("event_id % 50 <> 0").join(telemetry(spark, sf).where(F.col("k") % 6 == kind).select("event_id"), "event_id")
    rows = rows.select("event_id", mapping.parsed(m, F.col("raw")).alias("parts"))
    struct, lacks = mapping.compiled(m, F.col("parts"))
    return rows.select("event_id", struct.alias("f"), lacks.alias("lacks")).select("event_id", "lacks", *[F.col(f"f.{x}") for x in fields])


@query("norm_mapping_compile", "SELECT event_id, false AS lacks, seq, lat_e6, ts_ms AS ts_event FROM t WHERE event_id % 50 <> 0 AND k % 6 = 0")
def norm_mapping_compile(spark, sf):
    return _mapped(spark, sf, 0, 0, "seq", "lat_e6", "ts_event")


@query("norm_json_path", "SELECT event_id, false AS lacks, lat_e6, lon_e6, heading_deg FROM t WHERE event_id % 50 <> 0 AND k % 6 = 1")
def norm_json_path(spark, sf):
    return _mapped(spark, sf, 1, 1, "lat_e6", "lon_e6", "heading_deg")


@query("norm_signal_list", "SELECT event_id, false AS lacks, lat_e6, speed_kmh, charge_kw FROM t WHERE event_id % 50 <> 0 AND k % 6 = 2")
def norm_signal_list(spark, sf):
    return _mapped(spark, sf, 2, 2, "lat_e6", "speed_kmh", "charge_kw")


@query("norm_delimited", "SELECT event_id, false AS lacks, ts_ms AS ts_event, ignition FROM t WHERE event_id % 50 <> 0 AND k % 6 = 3")
def norm_delimited(spark, sf):
    return _mapped(spark, sf, 3, 3, "ts_event", "ignition")


# access and requests -----------------------------------------------------------------------------


class TokenBucket:
    """`rate` tokens a second up to `most`; a request takes one if there is one."""

    columns, schema = ("ts_ms",), "allowed boolean"
    start = {"ts_ms": -1, "tokens": 0.0}

    def __init__(self, rate: float = 10.0, most: float = 120.0):
        self.rate, self.most = rate, most

    def step(self, state, row):
        filled = state["tokens"] + (row["ts_ms"] - state["ts_ms"]) / 1000 * self.rate
        tokens = np.where(state["ts_ms"] < 0, self.most, np.minimum(self.most, filled))
        allowed = tokens >= 1
        return {"ts_ms": row["ts_ms"], "tokens": tokens - allowed}, {"when": np.ones_like(allowed), "allowed": allowed}


@query("p_rate_limit")
def p_rate_limit(spark, sf):
    """Requests a thousand times as fast as samples come, so that buckets run dry."""
    t = telemetry(spark, sf).select("vehicle_pid", (F.col("ts_ms") / 1000).cast("bigint").alias("ts_ms"), "seq")
    out = lockstep.run(t, "vehicle_pid", ["ts_ms", "seq"], TokenBucket(10.0, 5.0), ["vehicle_pid"])
    return out.groupBy("vehicle_pid").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


@query("p_jwt")
def p_jwt(spark, sf):
    """Tokens as requests might bring them: some signed with another key, some for another algorithm, some too old."""
    t, k = telemetry(spark, sf), F.col("k")
    token = access.token(F.to_json(F.struct(F.col("vehicle_pid").alias("sub"), F.floor(F.col("ts_ms") / 1000).alias("exp"))), "shared key")
    forged = access.token(F.to_json(F.struct(F.col("vehicle_pid").alias("sub"), F.floor(F.col("ts_ms") / 1000).alias("exp"))), "other key")
    token = F.when(k % 7 == 0, forged).when(k % 11 == 0, F.concat(F.lit("e30."), F.split_part(token, F.lit("."), F.lit(2)), F.lit(".x"))).when(k % 13 == 0, "no token").otherwise(token)
    claims = access.claims(token, "shared key", F.lit(T0_MS // 1000 + 2000))
    return t.select("event_id", claims.alias("c")).select("event_id", "c.verdict", "c.sub")


@query("p_mtls", "SELECT event_id, k % 3 = 0 OR k % 3 = 1 AND tenant_id IN (0, 1) AS allowed FROM t")
def p_mtls(spark, sf):
    """Subjects of client certificates against an allow-list of common names."""
    t, k = telemetry(spark, sf), F.col("k")
    subject = F.when(k % 3 == 0, "O=x, CN=gateway-1,C=DE").when(k % 3 == 1, F.concat(F.lit("cn=tenant-"), F.col("tenant_id"), F.lit(", O=CN=gateway-1"))).otherwise("O=gateway-1")
    return t.select("event_id", access.listed(subject, ["gateway-1", "tenant-0", "tenant-1"]).alias("allowed"))


@query("p_rbac", "SELECT event_id, k % 4 IN (0, 1) AS allowed FROM t")
def p_rbac(spark, sf):
    """Allowed: the platform's administrator, or any role of the list."""
    roles = F.array(F.element_at(F.array(F.lit("PLATFORM_ADMIN"), F.lit("FLEET_MANAGER"), F.lit("AUDITOR"), F.lit("GUEST")), F.col("k") % 4 + 1))
    ok = F.array_contains(roles, "PLATFORM_ADMIN") | F.arrays_overlap(roles, F.array(F.lit("FLEET_MANAGER"), F.lit("DISPATCHER")))
    return telemetry(spark, sf).select("event_id", ok.alias("allowed"))


@query("q_trip", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 7", telemetry=False)
def q_trip(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("q_driver", f", {SCORES} SELECT driver, {r('score', 4)} AS score, coalesce(top, 'NONE') AS top_risk FROM ds WHERE driver = '7'")
def q_driver(spark, sf):
    return scores(spark, sf).where("driver = '7'").select("driver", rc(F.col("score"), 4).alias("score"), F.coalesce("top_risk", F.lit("NONE")).alias("top_risk"))


@query("q_vehicles_bulk", "SELECT vehicle_pid, tenant_id FROM t WHERE CAST(vehicle_pid AS INTEGER) % 11 <> 0 GROUP BY 1, 2")
def q_vehicles_bulk(spark, sf):
    """Registry rows of a bulk request, the last of each vehicle."""
    reg = registry(spark, sf).withColumn("version", F.lit(1))
    return writers.upserted(reg, reg.withColumn("version", F.lit(2)), ["vehicle_pid"], "version").select("vehicle_pid", "tenant_id")


@query("q_sim", f"SELECT count(*) AS samples, count(DISTINCT vehicle_pid) AS vehicles, min(ts_ms) >= {T0_MS} AS begun FROM t")
def q_sim(spark, sf):
    return telemetry(spark, sf).agg(F.count("*").alias("samples"), F.countDistinct("vehicle_pid").alias("vehicles"), (F.min("ts_ms") >= T0_MS).alias("begun"))


@query("q_alert_stream", "SELECT event_id FROM t WHERE k <= 8")
def q_alert_stream(spark, sf):
    """A stream of low-charge alerts into a folder."""
    path, out = folder(spark, "alert-in"), folder(spark, "alert-out")
    t = telemetry(spark, sf).select("event_id", "soc_pct")
    t.write.parquet(path)
    stream = spark.readStream.schema(t.schema).parquet(path).where("soc_pct <= 8").select("event_id")
    q = stream.writeStream.option("checkpointLocation", folder(spark, "alert-offsets")).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema("event_id bigint").parquet(out)


@query("q_page_after", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 10", telemetry=False)
def q_page_after(spark, sf):
    """The second page of all orders, behind the first one's last row."""
    orders = table(spark, sf, "orders")
    last = paging.keyset_page(orders, "o_orderdate", "o_orderkey", 10).select("o_orderdate", "o_orderkey").collect()[-1]
    return paging.keyset_page(orders, "o_orderdate", "o_orderkey", 10, after=tuple(last)).select("o_orderkey")

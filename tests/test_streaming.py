import json

from pyspark.sql import functions as F

from motorcade.operators import mapping
from motorcade.operators.trips import trips as batch_trips
from motorcade.plans.telemetry import telemetry
from motorcade.sources import readers
from motorcade.streaming import pipeline

SF = "/root/testdata/sf0.001"
VIN = "1M8GDM9AXKP042788"


def files(df, path, n=3):
    for i in range(n):
        df.where(F.col("seq") % n == i).coalesce(1).write.mode("append").parquet(path)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streamed_trips_equal_batch(spark, tmp_path):
    pipeline.state_store(spark)
    t = telemetry(spark, SF).select("vehicle_pid", "tenant_id", "ts_ms", "seq", "lat_e6", "lon_e6", "speed_kmh", "ignition")
    t = t.where("cast(vehicle_pid as int) < 8")
    half = t.agg(F.percentile_approx("ts_ms", 0.5)).first()[0]
    path = str(tmp_path / "in")
    t.where(F.col("ts_ms") <= half).coalesce(1).write.parquet(path)
    src = spark.readStream.schema(t.schema).parquet(path)
    check = str(tmp_path / "check")

    def go():
        out = []
        q = pipeline.trips(src).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return out

    got = go()
    t.where(F.col("ts_ms") > half).coalesce(1).write.mode("append").parquet(path)
    got += go()  # a restart goes on from the stored state
    assert sorted(got) == sorted(map(tuple, batch_trips(t).collect())) and got


def test_dedup_within_watermark(spark, tmp_path):
    t = telemetry(spark, SF).select("vehicle_pid", "event_id", F.timestamp_millis("ts_ms").alias("ts"), "seq")
    files(t.unionByName(t.where("seq % 20 = 0")), str(tmp_path / "in"), 1)
    src = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    assert run(pipeline.deduplicated(src, "ts", ["vehicle_pid", "event_id"], "2 hours"), "dedup").count() == t.count()


def test_rollup_stream(spark, tmp_path):
    t = telemetry(spark, SF).withColumn("ts", F.timestamp_millis("ts_ms")).drop("dtc")
    files(t, str(tmp_path / "in"), 1)
    src = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = run(pipeline.rollup_10s(src), "rollup", "complete")
    assert got.count() == t.groupBy("tenant_id", "vehicle_pid", F.window("ts", "10 seconds")).count().count()


def test_reorder_stream_loses_nothing(spark, tmp_path):
    pipeline.state_store(spark)
    t = telemetry(spark, SF).select("vehicle_pid", "tenant_id", "ts_ms", "seq", "lat_e6", "lon_e6", "speed_kmh", "ignition").where("cast(vehicle_pid as int) < 5")
    # a last sample long after the others moves each vehicle's watermark past them
    last = t.groupBy("vehicle_pid", "tenant_id").agg((F.max("ts_ms") + 3_600_000).alias("ts_ms")).select("vehicle_pid", "tenant_id", "ts_ms", F.lit(10**9).cast("long").alias("seq"), F.lit(1).alias("lat_e6"), F.lit(1).alias("lon_e6"), F.lit(0.0).alias("speed_kmh"), F.lit(True).alias("ignition"))
    rows = t.unionByName(last).withColumn("arrival", F.col("ts_ms") + (F.col("seq") * 7919 % 9) * 1000)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = pipeline.split_late(pipeline.reordered(src), str(tmp_path / "clean"), str(tmp_path / "late"), str(tmp_path / "check"))
    q.awaitTermination(120)
    clean = spark.read.parquet(str(tmp_path / "clean"))
    late = spark.read.schema(clean.schema).parquet(str(tmp_path / "late"))
    assert clean.where("seq < 1000000000").count() + late.count() == t.count()


def test_ingest_takes_new_mappings_without_restart(spark, tmp_path):
    reg = spark.createDataFrame([(VIN, "v1", 1)], "vin string, vehicle_pid string, tenant_id int")
    mappings = mapping.Registry()
    (tmp_path / "in").mkdir()

    def send(name, oem, payload):
        (tmp_path / "in" / name).write_text(json.dumps({"oem": oem, "schema_ver": None, "recv_ms": 1767439805250, "raw": json.dumps(payload)}) + "\n")

    def go():
        q = pipeline.ingest(readers.raw_files(spark, str(tmp_path / "in")), reg, lambda: mappings, str(tmp_path / "clean"), str(tmp_path / "dead"), str(tmp_path / "check"))
        q.awaitTermination(120)

    send("a.json", "E", {"vin": VIN, "t": "2026-01-03T11:30:05.250Z", "lat": 13.0, "lon": 80.0, "spd": 10.0, "soc": 40.0})
    send("b.json", "F", {"id": VIN, "when": 1767439805250})
    go()
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 1
    mappings.register({"oem": "F", "schema_ver": 1, "format": "json", "vin_field": "id", "fields": {"ts_event": {"source": "when", "transform": "direct", "required": True}}})
    send("c.json", "F", {"id": VIN, "when": 1767439805250})
    go()
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 2
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert [r.reason_code for r in dead.select("reason_code").collect()] == ["UNKNOWN_OEM"]

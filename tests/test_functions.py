import base64
import hashlib
import hmac
import json
import math
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorcade.functions import codes, geo, ids, privacy
from motorcade.operators import mapping, normalize

#: Vehicle, time and readings of our own choice; field names, codes and units are those of the wire formats, fixed values.
VIN, OTHER = "1M8GDM9AXKP042788", "5GZCZ43D13S812715"
MS, WHEN = 1_767_439_805_250, "2026-01-03T11:30:05.250Z"
GOLDEN = [
    ("A", {"vehicleId": VIN, "timestamp": WHEN, "position": {"latitude": 48.1371, "longitude": 11.5754, "headingDeg": 205}, "speedKph": 51.0, "odometerKm": 9120.4, "ignition": "ON", "fuelLevelPct": 38.0, "dtcList": ["P0171"], "event": "HARSH_ACCEL", "msgSeq": 517}, {"heading_deg": 205, "odo_km": 9120.4, "ignition": True, "fuel_pct": 38.0, "dtc": ["P0171"], "evt": "HARSH_ACCEL", "seq": 517}),
    ("B", {"vin": VIN, "ts_epoch": MS / 1000, "gps": {"lat": 48.1371, "lng": 11.5754, "hdg": 205}, "speed_mph": 31.69, "odo_mi": 5667.154, "ign": 0, "fuel_frac": 0.38, "trouble_codes": "P0171;C0035", "evt_code": "HA", "counter": 517}, {"heading_deg": 205, "odo_km": 9120.4, "ignition": False, "fuel_pct": 38.0, "dtc": ["P0171", "C0035"], "evt": "HARSH_ACCEL", "seq": 517}),
    ("C", {"deviceId": VIN, "tsMs": MS, "signals": [{"n": "SPD", "v": 51.0}, {"n": "SOC", "v": 0.73}, {"n": "ODO", "v": 9120400}, {"n": "LAT", "v": 48.1371}, {"n": "LON", "v": 11.5754}, {"n": "CHG_KW", "v": 3.7}], "flags": ["HA"]}, {"soc_pct": 73.0, "odo_km": 9120.4, "charge_kw": 3.7, "evt": "HARSH_ACCEL", "ignition": None}),
    ("D", f"D1|{VIN}|{MS}|4813710|1157540|510|91204|0|380|P0171,C0035", {"odo_km": 9120.4, "ignition": False, "fuel_pct": 38.0, "dtc": ["P0171", "C0035"]}),
    ("E", {"v": 1, "vin": VIN, "t": WHEN, "lat": 48.1371, "lon": 11.5754, "spd": 51.0, "soc": 73.0}, {"soc_pct": 73.0}),
    ("E", {"v": 2, "vin": VIN, "t": WHEN, "loc": [11.5754, 48.1371], "spd_ms": 51 / 3.6, "batt": {"soc": 0.73, "volt": 401.5, "kw": -6.6}}, {"soc_pct": 73.0, "batt_voltage_v": 401.5, "charge_kw": 6.6, "charge_state": "CHARGING"}),
]


def geohash_text(lat, lon, precision):
    """Halving intervals bit by bit."""
    box, out, bits = [[-180.0, 180.0, lon], [-90.0, 90.0, lat]], "", ""
    for i in range(5 * precision):
        lo, hi, x = box[i % 2]
        mid = (lo + hi) / 2
        bits += "1" if x >= mid else "0"
        box[i % 2][:2] = [mid, hi] if x >= mid else [lo, mid]
        if len(bits) == 5:
            out, bits = out + geo.BASE32[int(bits, 2)], ""
    return out


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([(VIN, "v1", 1)], "vin string, vehicle_pid string, tenant_id int")


def test_golden_payloads(spark, registry):
    rows = [(o, None, MS, p if isinstance(p, str) else json.dumps(p)) for o, p, _ in GOLDEN]
    got = {(r.raw): r for r in normalize.normalize(spark.createDataFrame(rows, "oem string, schema_ver int, recv_ms bigint, raw string"), registry).collect()}
    for (_, _, _, raw), (_, _, want) in zip(rows, GOLDEN, strict=True):
        r = got[raw].asDict()
        assert r["reason_code"] is None and r["vin"] == VIN and r["ts_event"] == MS
        assert (r["lat_e6"], r["lon_e6"]) == (48137100, 11575400) and r["speed_kmh"] == pytest.approx(51.0, abs=1e-2)
        for k, v in want.items():
            assert r[k] == (pytest.approx(v, abs=0.05) if isinstance(v, float) else v), k


def test_rejections(spark, registry):
    good = GOLDEN[0][1]
    cases = [("{oops", "A", "MALFORMED"), (json.dumps(good), "Q", "UNKNOWN_OEM"), (json.dumps(good), None, "UNKNOWN_OEM"), (json.dumps(good | {"vehicleId": "SHORT"}), "A", "INVALID_VIN"), (json.dumps(good | {"vehicleId": OTHER}), "A", "UNKNOWN_VEHICLE"), (json.dumps({k: v for k, v in good.items() if k != "timestamp"}), "A", "MAPPING_ERROR")]
    rows = [(o, None, MS, raw) for raw, o, _ in cases]
    got = [r.reason_code for r in normalize.normalize(spark.createDataFrame(rows, "oem string, schema_ver int, recv_ms bigint, raw string").coalesce(1), registry).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(got) == sorted(w for _, _, w in cases)


def test_mappings_are_checked():
    with pytest.raises(ValueError):
        mapping.checked({"oem": "X"})
    with pytest.raises(ValueError):
        mapping.checked(mapping.BUILT_IN[0] | {"fields": {"speed_kmh": {"source": "a", "transform": "magic"}}})
    assert mapping.Registry().lookup("E", 9)["schema_ver"] == 2 and mapping.Registry().lookup("X", 1) is None


def test_vin(spark):
    r = one(spark, ok=codes.vin_valid(F.lit("1HGCM82633A004352")), bad=codes.vin_valid(F.lit("1HGCM82643A004352")), warn=codes.vin_valid(F.lit("1HGCM82643A004352"), strict=False), o=codes.vin_wellformed(F.lit("OHGCM82633A004352")), built=codes.vin_build(F.lit("1HGCM8263A004352")), null=codes.vin_wellformed(F.lit(None).cast("string")))
    assert r.ok and not r.bad and r.warn and not r.o and r.built == "1HGCM82633A004352" and r.null is False


def test_dtc(spark):
    r = one(spark, d=codes.dtc_parsed(F.array(F.lit("p0217"), F.lit("P0217"), F.lit("X1"), F.lit("P0299"), F.lit("U0100"), F.lit("P2463"))))
    assert [(x.code, x.system, x.generic, x.severity) for x in r.d] == [("P0217", "POWERTRAIN", True, "CRITICAL"), ("P0299", "POWERTRAIN", True, "HIGH"), ("U0100", "NETWORK", True, "MEDIUM"), ("P2463", "POWERTRAIN", False, "MEDIUM")]


def test_ids(spark):
    s = "v1:1700000000000"
    want = uuid.UUID(bytes=hashlib.md5(hashlib.sha256(s.encode()).digest()).digest(), version=3)
    r = one(spark, u=ids.uuid3(F.lit(s)), a=ids.to_u64(F.lit("ffffffffffffffff")), b=ids.to_u64(F.lit("42")), c=ids.to_u64(F.lit("not hex")))
    assert r.u == str(want) and int(r.a) == 2**64 - 1 and int(r.b) == 42 and int(r.c) == int(hashlib.md5(b"not hex").hexdigest()[:16], 16)


def test_pseudonym_and_noise(spark):
    key = "k" * 70
    want = base64.b32encode(hmac.new(key.encode(), b"vehicle-1", hashlib.sha256).digest()).decode()[:16]
    r = one(spark, p=privacy.pseudonym(F.lit("vehicle-1"), key), q=privacy.pseudonym(F.lit("vehicle-1"), "other"), m=privacy.mask(F.lit(37.774929), 3), n=privacy.mask(F.lit(-122.419416), 1))
    assert r.p == want != r.q and r.m == 37.775 and r.n == -122.4
    noise = [x.z for x in spark.range(4000).select(privacy.laplace(F.lit(0.0), 1.0, 0.5, privacy.uniform("s", F.col("id"))).alias("z")).collect()]
    assert abs(sum(noise) / len(noise)) < 0.2 and 1.8 < sum(map(abs, noise)) / len(noise) < 2.2
    with pytest.raises(ValueError):
        privacy.laplace(F.lit(0.0), 1.0, 0.0, F.lit(0.1))


def test_geohash(spark):
    pts = [(0.0, 0.0), (57.64911, 10.40744), (-89.9, -179.9), (13.0827, 80.2707), (90.0, 180.0)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    for r in df.select("lat", "lon", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("g")).withColumn("d", geo.geohash_decode(F.col("g"))).collect():
        assert r.g == geohash_text(r.lat, r.lon, 7)
        assert abs(r.d.lat - r.lat) <= r.d.lat_err * 1.0001 + 1e-9 and abs(r.d.lon - r.lon) <= r.d.lon_err * 1.0001 + 1e-9
    assert one(spark, g=geo.geohash(F.lit(57.64911), F.lit(10.40744), 11)).g == "u4pruydqqvj"
    near = one(spark, n=geo.geohash_neighbours(F.lit("dqcjq"), 5)).n
    assert sorted(near) == sorted(["dqcjw", "dqcjx", "dqcjr", "dqcjp", "dqcjn", "dqcjj", "dqcjm", "dqcjt"])


def test_cover_misses_no_cell(spark):
    cells = set(one(spark, c=geo.cover_bbox(F.lit(12.9), F.lit(77.5), F.lit(13.1), F.lit(77.7), 5)).c)
    for i in range(41):
        for j in range(41):
            assert geohash_text(12.9 + 0.2 * i / 40, 77.5 + 0.2 * j / 40, 5) in cells


@settings(max_examples=50, deadline=None)
@given(st.floats(-80, 80), st.floats(-170, 170), st.floats(-80, 80), st.floats(-170, 170))
def test_metres_is_a_metric(a, b, c, d):
    assert geo.metres(a, b, c, d) == pytest.approx(geo.metres(c, d, a, b), abs=1e-6) and 0 <= geo.metres(a, b, c, d) <= math.pi * geo.EARTH_M + 1

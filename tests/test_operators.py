import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorcade.config import REORDER, ReorderConfig
from motorcade.operators import algorithms, episodes, geofence, live, order, phases, rollups, sharing
from motorcade.operators.lockstep import Lanes
from motorcade.operators.trips import TripMachine, trips
from motorcade.checkpoints import ensure
from motorcade.plans.telemetry import telemetry
from motorcade.sources import readers, writers

SF = "/root/testdata/sf0.001"
COLS = "vehicle_pid string, tenant_id int, ts_ms bigint, seq bigint, lat_e6 int, lon_e6 int, speed_kmh double, ignition boolean, rpm int, charge_state string, charge_kw double, soc_pct double, heading_deg int, dtc array<string>"


def sample(i, s, speed=0.0, lat=13_000_000, on=True, state="NONE", kw=0.0, soc=50.0):
    return ("v", 1, 1_700_000_000_000 + s * 1000, i, lat, 80_000_000, speed, on, None, state, kw, soc, 90, [])


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def run_machine(machine, rows):
    """What a machine yields for samples of one vehicle, as dicts with the sample's number as `at`."""
    names = [c.split()[0] for c in COLS.split(", ")]
    table = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    table |= {"odo_km": [None] * len(rows), "lat": [x / 1e6 for x in table["lat_e6"]], "lon": [x / 1e6 for x in table["lon_e6"]]}
    number = lambda x: math.nan if x is None else float(x)
    columns = {c: np.array([number(x) for x in table[c]]).astype(np.int64 if c == "ts_ms" else float) for c in machine.columns}
    at, made = Lanes(machine).advance(np.zeros(len(rows), np.int64), columns)
    return [{"at": int(i), **{k: v[n].item() for k, v in made.items()}} for n, i in enumerate(at)]


def run_trips(rows):
    return run_machine(TripMachine(), rows)


def journey():
    rows = [sample(0, 0)]
    rows += [sample(i, i, 35.0, 13_000_000 + 50 * i) for i in range(1, 61)]
    rows += [sample(60 + i, 60 + i, 0.0, 13_003_000) for i in range(1, 300)]
    return rows


def test_jitter_makes_no_trip():
    rng = random.Random(1)
    assert not run_trips([sample(i, i, rng.uniform(0, 2), 13_000_000 + rng.randrange(-30, 30)) for i in range(100)])


def test_trip_closes_after_five_minutes(spark):
    rows = journey()
    assert not run_trips(rows)
    rows = [*rows, sample(361, 361, 0.0, 13_003_000), sample(362, 362, 0.0, 13_003_000)]
    done = run_trips(rows)
    assert len(done) == 1 and not done[0]["cut"]
    got = trips(frame(spark, rows)).collect()
    assert [(r.start_ms, r.end_ms, r.status) for r in got] == [(done[0]["start_ms"], done[0]["end_ms"], "COMPLETED")] and got[0].distance_km > 0.25


def test_unknown_ignition_and_gap():
    rows = [(*r[:7], None, *r[8:]) for r in journey()[:62]]
    assert [t["cut"] for t in run_trips([*rows, sample(99, 70, 0.0, 13_003_000, on=None)])] == [False]
    assert [t["cut"] for t in run_trips([*journey()[:61], sample(99, 2000, 35.0, 13_003_000)])] == [True]


def test_lanes_do_not_meet(spark):
    """Vehicles taken together, in batches of any size, give what each gives alone."""
    rows = [r.asDict() for r in telemetry(spark, SF).orderBy("ts_ms", "seq").collect()]
    machine = TripMachine()
    columns = {c: np.array([math.nan if r.get(c) is None else float(r[c]) for r in rows]).astype(np.int64 if c == "ts_ms" else float) for c in machine.columns}
    keys = np.array([r["vehicle_pid"] for r in rows], object)

    def found(parts):
        out = []
        lanes = {}
        for name, at in parts:
            i, made = lanes.setdefault(name, Lanes(machine)).advance(keys[at], {c: v[at] for c, v in columns.items()})
            out += [(keys[at[n]], *(made[k][m].item() for k in made)) for m, n in enumerate(i)]
        return sorted(out)

    alone = found([(k, np.flatnonzero(keys == k)) for k in sorted(set(keys))])
    assert alone and alone == found([("all", np.arange(len(keys)))]) == found([("all", np.arange(i, min(i + 77, len(keys)))) for i in range(0, len(keys), 77)])
    assert len(alone) == trips(telemetry(spark, SF)).count()


def test_idle_and_red_light(spark):
    stop = [sample(i, 10 * i, 0.0) for i in range(70)]
    one = episodes.idle_episodes(frame(spark, [*stop, sample(99, 701, 40.0)])).collect()
    assert len(one) == 1 and one[0].fuel_l > 0.2 and one[0].cost > 0.3 and one[0].avoidable_cost > 0
    assert not episodes.idle_episodes(frame(spark, [*stop[:9], sample(99, 90, 40.0)])).collect()
    assert not episodes.idle_episodes(frame(spark, [(*r[:7], None, *r[8:]) for r in stop] + [sample(99, 701, 40.0)])).collect()


def test_charging_session_and_range_risk(spark):
    rows = [sample(i, 60 * i, state="CHARGING", kw=11.0, soc=20 + 18 * i / 59) for i in range(60)] + [sample(99, 3600)]
    s = episodes.charging_sessions(frame(spark, rows))
    got = s.collect()
    assert len(got) == 1 and 10.5 < got[0].energy_kwh < 11.5 and got[0].cost_saving > 0.5 and 50 <= got[0].soh_estimate <= 100
    low = frame(spark, [sample(0, 0, soc=50.0), sample(1, 10, soc=12.0), sample(2, 60, soc=12.0), sample(3, 400, soc=7.0)])
    assert [r.severity for r in episodes.range_risk(low, s.limit(0)).orderBy("ts_ms").collect()] == ["HIGH", "CRITICAL"]


def test_fence_hysteresis_and_tow(spark):
    f = spark.createDataFrame([(1, "SITE", 13.0, 80.0, 100.0)], "fence_id int, type string, lat double, lon double, radius_m double")
    rows = [sample(0, 0), sample(1, 1), sample(2, 2, lat=13_900_000), sample(3, 3), sample(4, 4, lat=13_900_000), sample(5, 5, lat=13_900_000)]
    got = geofence.transitions(frame(spark, rows), f).orderBy("ts_ms").collect()
    assert [(r.transition, r.seq) for r in got] == [("ENTER", 1), ("EXIT", 5)]
    tow = episodes.tow_alerts(frame(spark, [sample(0, 0, on=False), sample(1, 30, lat=13_004_000, on=False)])).collect()
    assert len(tow) == 1 and tow[0].moved_m > 300


def test_phases_give_reasons(spark):
    run = lambda rows: [phases.REASONS[t["reason"]] for t in run_machine(phases.PhaseMachine(), rows)]
    drive = [sample(0, 0)] + [sample(i, i, 35.0, 13_000_000 + 50 * i) for i in range(1, 61)]
    assert run([*drive, sample(99, 61, 0.0, 13_003_000, on=False)]) == ["IGNITION_OFF"]
    assert not run([*drive[:20], sample(99, 21, 0.0, on=False)])
    assert run([*drive, sample(99, 1000, 35.0, 13_003_000)]) == ["DATA_GAP"]
    unknown = [sample(60 + i, 60 + i, 0.0, 13_003_000, on=None) for i in range(1, 310)]
    assert run([*drive, *unknown]) == ["STATIONARY_TIMEOUT"] and not run([*drive, *unknown[:290]])
    assert not run([*drive, *[sample(60 + i, 60 + 10 * i, 0.0, 13_003_000) for i in range(1, 200)]])
    idle = [sample(i, 10 * i) for i in range(20)]
    runs = lambda rows: [r.asDict() for r in phases.phase_idles(frame(spark, rows)).orderBy("start_ms").collect()]
    assert [(e["reason"], e["duration_s"]) for e in runs([*idle, sample(99, 200, 30.0)])] == [("SPEED_RESUME", 200.0)]
    assert [e["reason"] for e in runs([*idle, sample(99, 300)])] == ["GAP"] and [e["reason"] for e in runs([*idle, sample(99, 200, on=False)])] == ["IGNITION_OFF"]
    twice = [*idle, sample(50, 200, 30.0), *[sample(60 + i, 210 + 10 * i) for i in range(20)], sample(99, 410, 30.0)]
    first, second = runs(twice)
    assert second["cost"] == pytest.approx(first["cost"], rel=0.1) and not runs(idle)


def plain_buffer(events, c):
    """Arrival by arrival with the whole buffer looked through each time."""
    inside, out, late, top, gone = [], [], [], -1, -1
    for i, (ts, seq) in enumerate(events):
        if ts <= gone:
            late.append(i)
            continue
        top, inside = max(top, ts), sorted([*inside, (ts, seq, i)])
        while inside and (inside[0][0] <= top - c.lateness_ms or len(inside) > c.capacity):
            gone = inside[0][0]
            out.append(inside.pop(0)[2])
    return out, late, [x[2] for x in inside]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60_000), st.integers(0, 1000)), max_size=60), st.integers(1, 20))
def test_reorder_is_sorted_and_complete(events, capacity):
    c = ReorderConfig(lateness_ms=5000, capacity=capacity)
    for cuts in ([len(events)], range(0, len(events) + 1, 7)):
        held, mark, out, late, begin = [], order.Mark(), [], [], 0
        for end in [*cuts, len(events)]:
            now = [*held, *range(begin, end)]
            ts, seq = (np.array([events[i][k] for i in now], np.int64) for k in (0, 1))
            a, b, stay, mark = order.released(ts, seq, len(held), mark, c)
            out, late, held, begin = [*out, *(now[i] for i in a)], [*late, *(now[i] for i in b)], sorted((now[i] for i in stay), key=lambda i: (*events[i], i)), end
        want = plain_buffer(events, c)
        by = lambda x: [events[i] for i in x]
        assert (by(out), by(late), by(held)) == tuple(map(by, want))
        assert [events[i][0] for i in out] == sorted(events[i][0] for i in out)


def test_reordered_frame(spark):
    t = telemetry(spark, SF).withColumn("arrival", F.col("ts_ms") + (F.col("event_id") * 7919 % 31) * 1000)
    got = order.reordered(t, "arrival").collect()
    assert len(got) == t.count()
    by = {}
    for r in got:
        if r.route == "clean":
            by.setdefault(r.vehicle_pid, []).append((r.position, r.ts_ms))
    assert all([ts for _, ts in sorted(x)] == sorted(ts for _, ts in x) for x in by.values())
    assert all(r.quality & 2 for r in got if r.route == "late") and REORDER.lateness_ms == 10_000


def test_sequence_window(spark):
    df = spark.createDataFrame([("v", s, i) for i, s in enumerate((5, 6, 5, 20, 19, 19, 2, 13))], "vehicle_pid string, seq long, arrival long")
    got = [r.verdict for r in order.judged(df, "arrival", 8).orderBy("arrival").collect()]
    assert got == ["NEW", "NEW", "DUPLICATE", "NEW", "NEW", "DUPLICATE", "OUT_OF_WINDOW", "NEW"]


def test_gps_filter_relocates():
    rows = [sample(0, 0, 30.0, 13_000_000), sample(1, 1, 30.0, 13_000_100), *[sample(i, i, 30.0, 14_000_000) for i in range(2, 6)], sample(6, 5, 30.0, 0)]
    assert [x["suspect"] for x in run_machine(order.GpsMachine(), rows)] == [False, False, True, True, False, False, False]


def cost_of(labels, speeds, theta=5.0, lam=8.0):
    total = 0.0
    for i, (x, v) in enumerate(zip(labels, speeds, strict=True)):
        total += (((theta - v) / theta) ** 2 if v < theta else 0) if x == "MOVING" else min(1.0, (v / theta) ** 2)
        total += lam if i and labels[i - 1] != x else 0
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=1, max_size=8))
def test_viterbi_is_optimal(speeds):
    best = min(cost_of(x, speeds) for x in itertools.product(("MOVING", "STOPPED"), repeat=len(speeds)))
    assert cost_of(algorithms.viterbi(speeds), speeds) == pytest.approx(best)


def test_viterbi_smooths():
    assert set(algorithms.viterbi([60] * 5 + [1] + [60] * 5)) == {"MOVING"} and algorithms.viterbi([]) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([0.1, 0.2, 0.35]), min_size=1, max_size=4), st.integers(0, 4))
def test_charging_plan_is_cheapest(prices, need):
    p = algorithms.charging_plan(10.0, 10.0 + need, 20.0, prices, 11.0, 11.0, step=1.0)
    most = math.floor(11 * 0.25 * 0.92 + 1e-9)
    options = [c for c in itertools.product(range(most + 1), repeat=len(prices)) if sum(c) >= need]
    assert p.feasible == bool(options)
    if options:
        assert p.cost == pytest.approx(min(sum(a / 0.92 * q for a, q in zip(c, prices, strict=True)) for c in options), abs=1e-3)
        assert sum(p.slot_kwh) >= need


def test_charging_schedule_uses_the_cheap_slot():
    p = algorithms.charging_plan(20.0, 22.0, 60.0, [0.35, 0.35, 0.08, 0.35], 22.0, 11.0)
    assert p.slot_kwh[2] == max(p.slot_kwh) > 0 and p.saving > 0


def test_depot_cap_holds(spark):
    rows = [(1, str(i), 10.0, 14.0, 60.0, 22.0, 11.0, 12) for i in range(6)]
    req = spark.createDataFrame(rows, "depot_id bigint, request_id string, e0_kwh double, target_kwh double, max_kwh double, charger_kw double, vehicle_kw double, slots int")
    got = algorithms.allocate_depots(req, 30.0, [0.1] * 12).groupBy("slot").agg(F.sum("kwh").alias("k")).collect()
    assert all(r.k / 0.92 / 0.25 <= 30.0 + 1e-6 for r in got) and sum(r.k for r in got) > 0


def test_routes_agree():
    g = algorithms.Graph(*algorithms.grid_graph(8))
    plain, _ = g.search([0])
    back, _ = g.search([0], reverse=True)
    for n in (7, 35, 63):
        cost, path = g.path(0, n)
        assert cost == pytest.approx(plain[n]) and path[0] == 0 and path[-1] == n
    assert back[63] == pytest.approx(g.path(63, 0)[0]) and g.path(0, 999) == (math.inf, [])
    near = g.reachable(0, plain[9] + 1e-9, [9, 63, 0])
    assert [c for c, _ in near] == [0, 9]


def test_components_match_union_find(spark):
    ensure(spark)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = list(range(60))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in algorithms.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: root(n) for e in edges for n in e}


def test_no_small_group_is_shared(spark):
    rows = [(f"v{i}", "abcdef", 1) for i in range(4)] + [(f"v{i}", "abcxyz", 1) for i in range(9)]
    df = spark.createDataFrame(rows, "vehicle_pid string, geohash string, hour int")
    assert sharing.shared_cells(df, "TRAFFIC_DENSITY", 6, 0.5, "s").count() == 1
    assert sharing.shared_cells(df, "MOBILITY_FLOW", 3, 0.5, "s").first().vehicles == 9
    with pytest.raises(ValueError):
        sharing.shared_cells(df, "MOBILITY_FLOW", 6, 0.5, "s")
    big = spark.createDataFrame([("v1", "c", 100)] + [(f"w{i}", "c", 1) for i in range(20)], "k string, c string, n int")
    assert sharing.anonymous(big, ["c"], "k", "n").count() == 0


def test_chain_shows_tampering(spark):
    log = sharing.chained(spark.createDataFrame([(1, i, f"p{i}") for i in range(20)], "tenant_id int, seq bigint, payload string"))
    assert sharing.verified_chain(log).first().broken == 0
    changed = log.withColumn("payload", F.when(F.col("seq") == 7, "x").otherwise(F.col("payload")))
    assert sharing.verified_chain(changed).first().broken == 1


def test_ledger_loses_nothing(spark):
    from motorcade.operators.joins import reconcile

    ids = spark.range(2000).select((F.col("id") % 50).cast("string").alias("v"), "id")
    r = reconcile(ids, ids.unionByName(ids.where("id % 7 = 0")), "v", "id").agg(F.sum("missing").alias("m"), F.sum("duplicates").alias("d")).first()
    assert r.m == 0 and r.d == 286


def test_latest_keeps_first_of_equal_times(spark):
    df = frame(spark, [sample(2, 0, 1.0), sample(1, 0, 2.0)])
    assert live.latest(df).first().seq == 1


def test_activity_and_utilisation(spark):
    d = spark.createDataFrame([("a", i, 1.0) for i in range(8)] + [("b", i, 9.0) for i in range(8)], "vehicle_pid string, day int, hours double")
    assert {r.vehicle_pid: r.underused for r in rollups.utilisation(d, 4.0).collect()} == {"a": True, "b": False}


def test_archive_layout(spark, tmp_path):
    t = telemetry(spark, SF)
    writers.archived(t, str(tmp_path / "cold"))
    back = readers.archive(spark, str(tmp_path / "cold"), tenant=2, hour=0)
    assert back.count() == t.where("tenant_id = 2").where(F.hour(F.timestamp_millis("ts_ms")) == 0).count() > 0
    assert "PartitionFilters: [isnotnull(tenant" in back._jdf.queryExecution().executedPlan().toString()


def test_registry_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("vin,vehicle_pid,tenant_id,fleet_id,powertrain\nA,v1,1,2,EV\nB,v2,x,2,EV\n")
    assert [r.vin for r in readers.registry_csv(spark, str(tmp_path / "r.csv")).collect()] == ["A"]


def test_empty_inputs(spark):
    none = frame(spark, [])
    for df in (trips(none), episodes.idle_episodes(none), episodes.charging_sessions(none), live.live_state(none), order.gps_filtered(none)):
        assert df.count() == 0


def test_bloom_filter_rotates_and_errs_as_sized(spark):
    rows = spark.range(6000).select(F.lit(1).alias("tenant"), F.col("id").alias("key"), (F.col("id") * 10).alias("arrival"))
    again = rows.where("key % 100 = 0").withColumn("arrival", F.col("arrival") + 5)
    old = rows.where("key % 100 = 1 and key < 1000").withColumn("arrival", F.col("arrival") + 45_000)
    df = rows.withColumn("kind", F.lit("new")).unionByName(again.withColumn("kind", F.lit("again"))).unionByName(old.withColumn("kind", F.lit("old")))
    got = {r.kind: (r.n, r.seen) for r in order.bloom_seen(df, ["tenant"], "key", "arrival", 20_000, 2000, 0.01).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("seen").alias("seen")).collect()}
    assert got["again"] == (60, 60) and got["new"][0] == 6000 and got["new"][1] < 0.04 * 6000 and got["old"][1] <= 2


def test_nearest_against_all_pairs(spark):
    from motorcade.functions.geo import metres
    from motorcade.operators.joins import nearest

    rng = np.random.default_rng(1)
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-89, 89, 60), rng.uniform(-180, 180, 60), strict=True))]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 80), rng.uniform(-180, 180, 80), strict=True))] + [(100, 10.0, 179.99), (101, 89.9, 0.0)]
    got = {}
    for r in nearest(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(spots, "s int, lat double, lon double"), 3, "p", "s", finest=6).orderBy("p", "rank").collect():
        got.setdefault(r.p, []).append(r.s)
    for p, lat, lon in points:
        assert got[p] == [i for _, i in sorted((float(metres(lat, lon, a, b)), i) for i, a, b in spots)[:3]]


def test_snapped_against_a_loop(spark):
    nodes, _ = algorithms.grid_graph(6)
    rng = random.Random(2)
    points = [(i, 13.0 + rng.uniform(-0.02, 0.05), 80.0 + rng.uniform(-0.02, 0.05)) for i in range(200)]
    got = {r.point_id: r.node for r in algorithms.snapped(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(nodes, "node int, lat double, lon double")).collect()}
    deg = 500.0 / 111_000.0
    for i, lat, lon in points:
        from motorcade.functions.geo import metres

        rings = sorted((max(abs(int(a / deg) - int(lat / deg)), abs(int(b / deg) - int(lon / deg))), float(metres(lat, lon, a, b, 6_371_088.0)), n) for n, a, b in nodes)
        assert got.get(i) == (rings[0][2] if rings[0][0] <= 3 else None)


@pytest.mark.parametrize("few", (algorithms.FEW_NEAR, 0))
def test_snapped_points_stay_one_row(spark, monkeypatch, few):
    """Points are neither repeated by cell nor broadcast, however small their files look; a repeated point has one row."""
    monkeypatch.setattr(algorithms, "FEW_NEAR", few)
    nodes = spark.createDataFrame(algorithms.grid_graph(6)[0], "node int, lat double, lon double")
    points = spark.range(2000).selectExpr("id % 1990 as point_id", "13.0 + (id % 1990 % 41) / 2000 as lat", "80.0 + (id % 1990 % 37) / 2000 as lon")
    df = algorithms.snapped(points, nodes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and ("BroadcastHashJoin" if few else "SortMergeJoin") in plan and ("BuildLeft" not in plan)
    got = {r.point_id: r.node for r in df.collect()}
    assert len(got) == df.count() == 1990
    for i in (0, 40, 1989):
        lat, lon = 13.0 + i % 41 / 2000, 80.0 + i % 37 / 2000
        deg = 500.0 / 111_000.0
        assert got[i] == min((max(abs(int(a / deg) - int(lat / deg)), abs(int(b / deg) - int(lon / deg))), (a - lat) ** 2 + (b - lon) ** 2 * math.cos(math.radians(13)) ** 2, n) for n, a, b in algorithms.grid_graph(6)[0])[2]


def test_tokens_and_names(spark):
    from motorcade.functions import access

    key = "k" * 10
    good = access.token(F.lit('{"sub":"a","exp":100}'), key)
    r = spark.range(1).select(*[access.claims(t, key, F.lit(now)).alias(n) for n, t, now in (("ok", good, 99), ("old", good, 100), ("key", access.token(F.lit('{"sub":"a","exp":100}'), "z"), 9), ("bad", F.lit("a.b"), 9), ("none", F.lit("eyJhbGciOiJub25lIn0.e30."), 9), ("null", F.lit(None).cast("string"), 9))], access.common_name(F.lit("O=CN=x, CN=y")).alias("cn")).first()
    assert (r.ok.verdict, r.ok["sub"], r.old.verdict, r.key.verdict, r.bad.verdict, r.none.verdict, r.cn) == ("OK", "a", "EXPIRED", "BAD_SIGNATURE", "MALFORMED", "BAD_ALGORITHM", "y")
    import base64, hashlib, hmac, json

    head, body, sig = spark.range(1).select(good.alias("t")).first().t.split(".")
    pad = lambda x: x + "=" * (-len(x) % 4)
    assert json.loads(base64.urlsafe_b64decode(pad(body))) == {"sub": "a", "exp": 100}
    assert base64.urlsafe_b64decode(pad(sig)) == hmac.new(key.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()

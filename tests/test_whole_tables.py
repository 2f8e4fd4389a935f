"""Queries that must read all rows of tables larger than the smallest."""

import duckdb
import pytest
from pyspark.sql import functions as F

from motorcade.operators import sharing
from motorcade.plans import scalars
from motorcade.registry import ORACLE, QUERIES
from tests.test_oracle import ordered, plain

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in ("events", "orders"):
        c.execute(f"create view {t} as from '{MIDDLE}/{t}.parquet'")
    return c


def same(spark, duck, name):
    rel = duck.execute(ORACLE[name])
    cols = [d[0] for d in rel.description]
    want = ordered(tuple(map(plain, r)) for r in rel.fetchall())
    got = ordered(tuple(plain(r[c]) for c in cols) for r in QUERIES[name](spark, MIDDLE).collect())
    assert got == want
    return got


def test_audit_chain_holds_all_rows(spark, duck):
    n = duck.execute("select count(*) from events").fetchone()[0]
    assert len(same(spark, duck, "p_audit_chain")) == n
    assert sum(r[1] for r in same(spark, duck, "q_audit")) == n
    # every link once more, by a plain loop
    before = {}
    for r in sorted(QUERIES["p_audit_chain"](spark, MIDDLE).collect(), key=lambda r: (r.tenant_id, r.seq)):
        assert r.prev_hash == before.get(r.tenant_id, "0" * 64) and r.hash == sharing.link(r.prev_hash, r.payload)
        before[r.tenant_id] = r.hash


def test_geo_neighbours_of_all_rows(spark, duck):
    assert len(same(spark, duck, "geo_neighbors")) == duck.execute("select count(*) from events").fetchone()[0]


def test_dead_letters_of_all_payloads(spark, duck, monkeypatch):
    """A row that is broken outside every fiftieth is seen."""
    count = lambda: {r.reason_code: r.n for r in QUERIES["sink_dlq"](spark, MIDDLE).collect()}
    same(spark, duck, "sink_dlq")
    before, given = count(), scalars.payloads
    broken = lambda spark, sf: given(spark, sf).withColumn("raw", F.when(F.col("event_id") == 7, "{").otherwise(F.col("raw")))
    monkeypatch.setattr(scalars, "payloads", broken)
    assert count()["MALFORMED"] == before["MALFORMED"] + 1


def test_page_behind_another(spark, duck):
    assert len(same(spark, duck, "q_page_after")) == 10


def test_charging_without_power_stays_charging(spark):
    """A payload that tells charging by the sign of its power keeps it at zero; a power that isn't given tells nothing."""
    from motorcade.operators import mapping, normalize
    from motorcade.plans.telemetry import telemetry

    m = mapping.Registry().lookup("E", 2)
    for state, kw, want in (("CHARGING", 0.0, ("CHARGING", 0.0)), ("CHARGING", 6.5, ("CHARGING", 6.5)), ("NONE", 0.0, ("NONE", 0.0)), ("CHARGING", None, (None, 0.0))):
        t = telemetry(spark, MIDDLE).where("event_id = 1").withColumns({"vin": F.lit("v"), "charge_state": F.lit(state), "charge_kw": F.lit(kw).cast("double")})
        r = t.select(mapping.parsed(m, normalize.encode(t, "E", 2)).alias("p")).select(mapping.compiled(m, F.col("p"))[0].alias("f")).select("f.*").first()
        assert r.charge_state == want[0] and r.charge_kw == pytest.approx(want[1])


def test_point_on_an_edge(spark):
    """A point on an edge falls on the side on which the SQL, whose fence coordinates are decimals, has it."""
    import duckdb

    from motorcade.functions import geo

    points = [(i, 13_000_000 + (i % 97) * 1000 + i % 100 * 45, 80_200_000 + (i % 89) * 1200 + i % 100 * 55) for i in range(0, 863_300, 211)]
    points += [(-1, 13_051_450, 80_285_750), (-2, 13_030_900, 80_251_500), (-3, 13_055_800, 80_207_000), (-4, 13_053_700, 80_210_500)]
    c = duckdb.connect()
    c.execute("create table t (event_id int, lat_e6 int, lon_e6 int)")
    c.executemany("insert into t values (?, ?, ?)", points[-500:])
    want = dict(c.execute(scalars._ring_sql()).fetchall())
    df = spark.createDataFrame(points[-500:], "event_id int, lat_e6 int, lon_e6 int")
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in scalars.RING])
    assert {r.event_id: r.inside for r in df.select("event_id", geo.in_polygon(df.lat_e6 / 1e6, df.lon_e6 / 1e6, ring).alias("inside")).collect()} == want
    assert spark.range(1).select(geo.in_polygon(F.lit(0.5), F.lit(1e-30), F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1e-29), (0.0, 1e-29))])).alias("x")).first().x


def test_point_on_a_fence(spark):
    """The same for fences met by cells: of three neighbours on one parallel, the one on the edge is outside as in the SQL."""
    from motorcade.operators import geofence

    ring = spark.createDataFrame([(1, [{"lat": a, "lon": b} for a, b in scalars.RING])], "fence_id int, ring array<struct<lat:double,lon:double>>")
    rows = spark.createDataFrame([(i, 13_051_450, 80_285_749 + i) for i in range(3)], "event_id int, lat_e6 int, lon_e6 int")
    assert sorted(r.event_id for r in geofence.inside_polygons(rows, ring).collect()) == [2]


def test_fences_at_every_edge(spark, tmp_path):
    """Both polygon queries against their SQL at all places telemetry can have (remainders of keys, k under 100) that lie on an edge's line or within 10 millionths of a degree of it."""
    c = duckdb.connect()
    slope = "abs(3 * (lon - 80250000) {} 5 * (lat - 13030000)) <= 30"
    near = f"{slope.format('-')} or {slope.format('+')} or lat in (13000000, 13060000) or abs(lon - 80200000) <= 10 or abs(lon - 80300000) <= 10"
    places = "select u, k, 13000000 + u % 97 * 1000 + k * 45 as lat, 80200000 + u % 89 * 1200 + k * 55 as lon from range(97 * 89) a(u), range(100) b(k)"
    rows = f"select row_number() over (order by u, k) as event_id, timestamp '2024-01-01' as ts, u as user_id, 'view' as event_type, 1.0::double as value, '{{\"k\": ' || k || '}}' as props from ({places}) where {near}"
    c.execute(f"copy ({rows}) to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as from '{tmp_path}/events.parquet'")
    for name, most in (("j_geofence_polygon", "fence_id"), ("geo_point_in_polygon", "inside")):
        want = ordered(c.execute(f"select event_id, {most} from ({ORACLE[name]})").fetchall())
        assert want and ordered((r.event_id, r[most]) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want

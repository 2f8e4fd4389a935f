"""SQL for queries whose rows follow from windows, closures or keyed hashes rather than from the step-by-step form."""

from __future__ import annotations

from motorcade.plans.base import ORACLE
from motorcade.plans.scalars import KEY
from motorcade.plans.stateful import ARRIVAL, GRID, _grid_sql
from motorcade.plans.telemetry import TELEMETRY, geohash_sql, r

LAT, LON = "lat_e6 / 1e6", "lon_e6 / 1e6"


def _hmac(message: str, key: str) -> str:
    """DuckDB: HMAC-SHA256 in hex of a text, for a key of at most 64 bytes."""
    raw = key.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ p:02x}" for b in raw) for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _base32(hexed: str, letters: int) -> str:
    parts = []
    for i in range(letters):
        start, offset = 5 * i // 4, 5 * i % 4
        parts.append(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr({hexed}, {start + 1}, 3) AS INTEGER) >> {12 - 5 - offset}) & 31) + 1, 1)")
    return " || ".join(parts)


# A sample is late if an earlier arrival at or after its time had already passed the watermark; the rest leave in order.
ORACLE["st_reorder"] = f"""WITH {TELEMETRY}, a AS (SELECT *, {ARRIVAL} AS arrival FROM t),
o AS (SELECT *, row_number() OVER w AS rn, max(ts_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10000 AS mark FROM a WINDOW w AS (PARTITION BY vehicle_pid ORDER BY arrival, seq)),
l AS (SELECT i.vehicle_pid, i.ts_ms, i.seq, coalesce(max(j.ts_ms) >= i.ts_ms, false) AS late FROM o i LEFT JOIN o j ON j.vehicle_pid = i.vehicle_pid AND j.rn < i.rn AND j.ts_ms <= i.mark GROUP BY i.vehicle_pid, i.ts_ms, i.seq)
SELECT vehicle_pid, ts_ms, seq, CASE WHEN late THEN 2 ELSE 0 END AS quality, CASE WHEN late THEN 'late' ELSE 'clean' END AS route, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY vehicle_pid, late ORDER BY ts_ms, seq) END AS position FROM l"""

ORACLE["p_pseudonym"] = f"WITH {TELEMETRY}, h AS (SELECT vehicle_pid, {_hmac('vehicle_pid', KEY)} AS h FROM (SELECT DISTINCT vehicle_pid FROM t)) SELECT vehicle_pid, {_base32('h', 16)} AS pseudonym FROM h"

ORACLE["p_laplace"] = f"""WITH {TELEMETRY}, h AS (SELECT tenant_id, n, (CAST('0x' || substr({_hmac('CAST(tenant_id AS VARCHAR)', 'secret')}, 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 - 0.5 AS u FROM (SELECT tenant_id, count(*)::DOUBLE AS n FROM t GROUP BY 1))
SELECT tenant_id, n, {r('n - 2.0 * sign(u) * ln(1.0 - 2.0 * abs(u))', 6)} AS noisy FROM h"""

_X, _Y = f"CAST(floor(({LON} + 180.0) / 360.0 * 262144) AS BIGINT)", f"CAST(floor(({LAT} + 90.0) / 180.0 * 131072) AS BIGINT)"
_CELLS = f"""b AS (SELECT {_X} AS x, {_Y} AS y, {geohash_sql(LAT, LON, 7)} AS cell FROM t GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT p.cell AS a, q.cell AS b FROM b p JOIN b q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND p.cell <> q.cell),
c AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)"""
ORACLE["u_union_find"] = f"WITH RECURSIVE {TELEMETRY}, {_CELLS} SELECT node, min(seen) AS component FROM c GROUP BY 1"
ORACLE["q_unapproved_depots"] = f"WITH RECURSIVE {TELEMETRY}, {_CELLS}, u AS (SELECT node, min(seen) AS component FROM c GROUP BY 1) SELECT component, count(*) AS cells FROM u GROUP BY 1 HAVING count(*) >= 2"


def _from_sources(tail: str) -> str:
    rounds = [f"d0 AS (SELECT s AS src, s AS node, 0.0::DOUBLE AS dist FROM range(0, {GRID * GRID}, 40) x(s))"]
    for i in range(1, 2 * GRID + 6):
        rounds.append(f"d{i} AS (SELECT src, node, min(dist) AS dist FROM (SELECT src, node, dist FROM d{i - 1} UNION ALL SELECT d{i - 1}.src, w.dst, dist + kwh FROM d{i - 1} JOIN w ON w.src = d{i - 1}.node) GROUP BY 1, 2)")
    return f"WITH {_grid_sql()}, w AS (SELECT src, dst, km * (0.15 + 0.00003 * (kmh - 50) * (kmh - 50)) AS kwh FROM e), {', '.join(rounds)}, z AS (SELECT src, node, dist FROM d{2 * GRID + 5}) " + tail


_NEAR = "SELECT CAST(src AS INTEGER) AS src, CAST(node AS INTEGER) AS charger, {v} AS kwh{rank} FROM z WHERE node IN (0, 30, 77, 100, 143) AND dist < 2.5"
ORACLE["graph_reachable"] = _from_sources(_NEAR.format(v=r("dist", 6), rank=""))
ORACLE["q_nearest_charger"] = _from_sources("SELECT * FROM (" + _NEAR.format(v=r("dist", 6), rank=", CAST(row_number() OVER (PARTITION BY src ORDER BY dist, node) AS INTEGER) AS rank") + ") WHERE rank <= 3")

# Cheapest ways, which are unique on the grid, with the nodes that they pass.
_WAYS = [f"d0 AS (SELECT s AS src, s AS node, 0.0::DOUBLE AS dist, CAST(s AS VARCHAR) AS path FROM range(0, {GRID * GRID}, 40) x(s))"]
for _i in range(1, 2 * GRID + 6):
    _on = f"SELECT src, node, dist, path FROM d{_i - 1} UNION ALL SELECT d.src, w.dst, dist + kwh, path || '>' || w.dst FROM d{_i - 1} d JOIN w ON w.src = d.node"
    _WAYS.append(f"d{_i} AS (SELECT src, node, min(dist) AS dist, arg_min(path, dist) AS path FROM ({_on}) GROUP BY 1, 2)")
ORACLE["graph_astar"] = f"WITH {_grid_sql()}, w AS (SELECT src, dst, km * (0.15 + 0.00003 * (kmh - 50) * (kmh - 50)) AS kwh FROM e), {', '.join(_WAYS)} SELECT CAST(src AS INTEGER) AS src, {r('dist', 6)} AS cost, path FROM d{2 * GRID + 5} WHERE node = {GRID * GRID - 1}"

# Charging at once at full power, slot by slot.
_BASE = ["p0 AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, 15.0::DOUBLE AS e, least(55.0, 15.0 + abs(c_acctbal) / 400.0) AS target, 0.0::DOUBLE AS cost FROM customer)"]
for _i in range(24):
    _price = 0.12 if _i % 8 < 5 else 0.28
    _power = "CASE WHEN e / 60.0 <= 0.8 THEN 11.0 ELSE 11.0 * (1 - (e / 60.0 - 0.8) / 0.2 * 0.9) END"
    _add = f"CASE WHEN e >= target THEN 0.0 ELSE least(({_power}) * 0.25 * 0.92, target - e, 60.0 - e) END"
    _BASE.append(f"p{_i + 1} AS (SELECT request_id, e + ({_add}) AS e, target, cost + ({_add}) / 0.92 * {_price} AS cost FROM p{_i})")
ORACLE["dp_baseline"] = "WITH " + ", ".join(_BASE) + f" SELECT request_id, {r('cost', 4)} AS baseline FROM p24"


def _trips_sql() -> str:
    """The trip state machine row by row: state 0 of a vehicle is its first sample's, each step takes the next sample."""
    from motorcade.plans.telemetry import haversine_sql, uuid3_sql

    moved = haversine_sql("alat / 1e6", "alon / 1e6", "lat / 1e6", "lon / 1e6")
    step = haversine_sql("llat / 1e6", "llon / 1e6", "lat / 1e6", "lon / 1e6")
    gh = lambda a, b: geohash_sql(f"{a} / 1e6", f"{b} / 1e6", 7)
    return f"""WITH RECURSIVE {TELEMETRY}, num AS (SELECT vehicle_pid, tenant_id, ts_ms AS now, lat_e6 AS lat, lon_e6 AS lon, speed_kmh AS speed, ignition, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS rn FROM t),
f AS (SELECT vehicle_pid, tenant_id, 0::BIGINT AS rn, 'STOPPED' AS phase, lat AS alat, lon AS alon, lat AS llat, lon AS llon, now AS seen, 0::BIGINT AS since, 0::BIGINT AS start, 0 AS olat, 0 AS olon, 0.0::DOUBLE AS km, 0::BIGINT AS idle, NULL::VARCHAR AS status, 0::BIGINT AS c_start, 0 AS c_olat, 0 AS c_olon, 0.0::DOUBLE AS c_km, 0::BIGINT AS c_idle FROM num WHERE rn = 1
UNION ALL
SELECT vehicle_pid, tenant_id, rn, CASE WHEN shut IS NOT NULL THEN 'STOPPED' ELSE next END, CASE WHEN shut IS NOT NULL THEN lat WHEN ema THEN CAST(trunc(alat * 0.9 + lat * 0.1) AS INTEGER) ELSE alat END, CASE WHEN shut IS NOT NULL THEN lon WHEN ema THEN CAST(trunc(alon * 0.9 + lon * 0.1) AS INTEGER) ELSE alon END, lat, lon, now,
  CASE WHEN next <> phase AND next IN ('CANDIDATE', 'HALT') THEN now ELSE since END, CASE WHEN begun THEN since ELSE start END, CASE WHEN begun THEN lat ELSE olat END, CASE WHEN begun THEN lon ELSE olon END, CASE WHEN begun OR shut IS NOT NULL THEN 0.0 ELSE km2 END, CASE WHEN begun OR shut IS NOT NULL THEN 0 ELSE idle2 END,
  shut, start, olat, olon, km2, idle2
FROM (SELECT *, CASE WHEN phase = 'TRIP' OR (phase = 'HALT' AND speed >= 5) THEN km + CASE WHEN step > 2 AND step < 2000 THEN step / 1000 ELSE 0.0 END ELSE km END AS km2, CASE WHEN phase = 'HALT' THEN idle + (now - seen) // 1000 ELSE idle END AS idle2,
    CASE WHEN phase = 'TRIP' AND now - seen >= 900000 THEN 'TRUNCATED' WHEN phase = 'HALT' AND speed < 5 AND (NOT ignition OR (now - since) // 1000 >= 300) THEN 'COMPLETED' END AS shut,
    phase = 'STOPPED' AND NOT (speed >= 5 AND moved >= 30) AND moved < 30 AS ema, phase = 'CANDIDATE' AND speed >= 1 AND ((now - since) // 1000 >= 10 OR moved >= 50) AS begun,
    CASE phase WHEN 'STOPPED' THEN CASE WHEN speed >= 5 AND moved >= 30 THEN 'CANDIDATE' ELSE 'STOPPED' END WHEN 'CANDIDATE' THEN CASE WHEN speed < 1 THEN 'STOPPED' WHEN (now - since) // 1000 >= 10 OR moved >= 50 THEN 'TRIP' ELSE 'CANDIDATE' END WHEN 'TRIP' THEN CASE WHEN speed < 1 THEN 'HALT' ELSE 'TRIP' END ELSE CASE WHEN speed >= 5 THEN 'TRIP' ELSE 'HALT' END END AS next
  FROM (SELECT f.vehicle_pid, f.tenant_id, n.rn, f.phase, f.alat, f.alon, f.seen, f.since, f.start, f.olat, f.olon, f.km, f.idle, n.now, n.lat, n.lon, n.speed, n.ignition, {moved.replace('alat', 'f.alat').replace('alon', 'f.alon').replace('(lat', '(n.lat').replace('(lon', '(n.lon')} AS moved, {step.replace('llat', 'f.llat').replace('llon', 'f.llon').replace('(lat', '(n.lat').replace('(lon', '(n.lon')} AS step FROM f JOIN num n ON n.vehicle_pid = f.vehicle_pid AND n.rn = f.rn + 1)))
SELECT {uuid3_sql("vehicle_pid || ':' || c_start")} AS trip_id, vehicle_pid, tenant_id, c_start AS start_ms, seen AS end_ms, c_olat AS start_lat_e6, c_olon AS start_lon_e6, {gh('c_olat', 'c_olon')} AS start_geohash7, llat AS end_lat_e6, llon AS end_lon_e6, {gh('llat', 'llon')} AS end_geohash7,
  {r('c_km')} AS distance_km, CAST(greatest(1, (seen - c_start) // 1000) AS INTEGER) AS duration_s, CAST(c_idle AS INTEGER) AS idle_s, {r('c_km * 0.08')} AS fuel_l, {r('c_km * 0.08 * 1.45', 2)} AS cost, {r('c_km * 0.08 * 2.31', 2)} AS co2_kg, status FROM f WHERE status IS NOT NULL"""


ORACLE["st_trip_fsm"] = _trips_sql()


def _stepped(rows: str, start: str, columns: str, inner: str, tail: str) -> str:
    """Row by row over `num`: `start` gives state columns from a vehicle's first row, `inner` those after the next row n."""
    return f"WITH RECURSIVE {TELEMETRY}, num AS ({rows}), f AS (SELECT vehicle_pid, rn, ts_ms, seq, {start} FROM num WHERE rn = 1 UNION ALL SELECT vehicle_pid, rn, ts_ms, seq, {columns} FROM ({inner})) {tail}"


_GPS_KM = "6371008.8 * 2 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
ORACLE["st_gps_filter"] = _stepped(
    "SELECT vehicle_pid, ts_ms, seq, lat_e6 / 1e6 AS lat, lon_e6 / 1e6 AS lon, speed_kmh, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS rn FROM t",
    "lat AS alat, lon AS alon, ts_ms AS ats, 0 AS streak, 0.0::DOUBLE AS slat, 0.0::DOUBLE AS slon, false AS suspect",
    "CASE WHEN taken THEN lat ELSE alat END, CASE WHEN taken THEN lon ELSE alon END, CASE WHEN taken THEN ts_ms ELSE ats END, CASE WHEN taken THEN 0 WHEN same THEN streak ELSE streak + 1 END, CASE WHEN taken THEN 0.0 WHEN same THEN slat ELSE slat + lat END, CASE WHEN taken THEN 0.0 WHEN same THEN slon ELSE slon + lon END, NOT taken AND NOT same",
    "SELECT *, NOT same AND (kmh <= CASE WHEN speed_kmh >= 2 THEN greatest(250.0, 3 * speed_kmh) ELSE 250.0 END OR (streak >= 2 AND "
    + _GPS_KM.format(a="((slat + lat) / (streak + 1))", b="((slon + lon) / (streak + 1))", c="lat", d="lon")
    + " <= 100)) AS taken FROM (SELECT f.vehicle_pid, n.rn, n.ts_ms, n.seq, f.alat, f.alon, f.ats, f.streak, f.slat, f.slon, n.lat, n.lon, n.speed_kmh, n.ts_ms <= f.ats AS same, CASE WHEN n.ts_ms > f.ats THEN "
    + _GPS_KM.format(a="f.alat", b="f.alon", c="n.lat", d="n.lon")
    + " / 1000 / ((n.ts_ms - f.ats) / 3600000) END AS kmh FROM f JOIN num n ON n.vehicle_pid = f.vehicle_pid AND n.rn = f.rn + 1)",
    "SELECT vehicle_pid, ts_ms, seq, suspect FROM f",
)
ORACLE["p_rate_limit"] = _stepped(
    "SELECT vehicle_pid, ts_ms // 1000 AS ts_ms, seq, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms // 1000, seq) AS rn FROM t",
    "4.0::DOUBLE AS tokens, true AS allowed",
    "CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1",
    "SELECT f.vehicle_pid, n.rn, n.ts_ms, n.seq, least(5.0, f.tokens + (n.ts_ms - f.ts_ms) / 1000 * 10.0) AS have FROM f JOIN num n ON n.vehicle_pid = f.vehicle_pid AND n.rn = f.rn + 1",
    "SELECT vehicle_pid, count(*) AS requests, count(*) FILTER (allowed) AS allowed FROM f GROUP BY 1",
)
_SOC = "least(100.0, greatest(0.0, {s} + charge_kw / 60 * 5 - speed_kmh * 0.01))"
ORACLE["gen_physics"] = _stepped(
    "SELECT vehicle_pid, ts_ms, seq, charge_kw, speed_kmh, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS rn FROM t",
    _SOC.format(s="50.0") + "::DOUBLE AS soc",
    _SOC.format(s="before"),
    "SELECT f.vehicle_pid, n.rn, n.ts_ms, n.seq, f.soc AS before, n.charge_kw, n.speed_kmh FROM f JOIN num n ON n.vehicle_pid = f.vehicle_pid AND n.rn = f.rn + 1",
    f"SELECT vehicle_pid, ts_ms, seq, {r('soc', 6)} AS soc FROM f",
)

# Two-state labelling: costs forward, then labels back along the cheapest predecessors.
_FIT_M, _FIT_S = "CASE WHEN v < 5.0 THEN ((5.0 - v) / 5.0) * ((5.0 - v) / 5.0) ELSE 0.0 END", "least(1.0, (v / 5.0) * (v / 5.0))"
ORACLE["dp_viterbi"] = f"""WITH RECURSIVE {TELEMETRY}, num AS (SELECT vehicle_pid, ts_ms // 86400000 AS day, ts_ms, seq, speed_kmh AS v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY vehicle_pid, ts_ms // 86400000) AS n FROM t WINDOW w AS (PARTITION BY vehicle_pid, ts_ms // 86400000 ORDER BY ts_ms, seq)),
g AS (SELECT vehicle_pid, day, rn, n, ({_FIT_M})::DOUBLE AS cm, ({_FIT_S})::DOUBLE AS cs, 0 AS fm, 0 AS fs FROM num WHERE rn = 1 UNION ALL
  SELECT vehicle_pid, day, rn, n, CASE WHEN cm <= cs + 8 THEN cm ELSE cs + 8 END + {_FIT_M}, CASE WHEN cm + 8 <= cs THEN cm + 8 ELSE cs END + {_FIT_S}, CASE WHEN cm <= cs + 8 THEN 0 ELSE 1 END, CASE WHEN cm + 8 <= cs THEN 0 ELSE 1 END
  FROM (SELECT g.vehicle_pid, g.day, x.rn, g.n, g.cm, g.cs, x.v FROM g JOIN num x ON x.vehicle_pid = g.vehicle_pid AND x.day = g.day AND x.rn = g.rn + 1)),
b AS (SELECT vehicle_pid, day, rn, CASE WHEN cm <= cs THEN 0 ELSE 1 END AS s, fm, fs FROM g WHERE rn = n UNION ALL
  SELECT g.vehicle_pid, g.day, g.rn, CASE WHEN b.s = 0 THEN b.fm ELSE b.fs END, g.fm, g.fs FROM b JOIN g ON g.vehicle_pid = b.vehicle_pid AND g.day = b.day AND g.rn = b.rn - 1)
SELECT vehicle_pid, ts_ms, seq, CASE WHEN s = 0 THEN 'MOVING' ELSE 'STOPPED' END AS label FROM b JOIN num USING (vehicle_pid, day, rn)"""


ORACLE["st_silent_flush"] = f"WITH r AS ({ORACLE['st_reorder']}), x AS (SELECT *, max(ts_ms) OVER (PARTITION BY vehicle_pid) AS top FROM r) SELECT vehicle_pid, ts_ms, seq, position FROM x WHERE route = 'clean' AND ts_ms > top - 10000"

_ORDERED = "WINDOW w AS (PARTITION BY vehicle_pid ORDER BY ts_ms, seq)"
ORACLE["st_idle_py"] = f"""WITH {TELEMETRY}, x AS (SELECT *, ignition AND speed_kmh < 2 AS idle, (ts_ms - lag(ts_ms) OVER w) / 1000.0 AS step FROM t {_ORDERED}),
y AS (SELECT *, idle AND (NOT coalesce(lag(idle) OVER w, false) OR step > 600) AS first FROM x {_ORDERED}),
z AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS run, lead(ts_ms) OVER w AS next_ms, lead(ignition) OVER w AS next_on FROM y {_ORDERED}),
g AS (SELECT vehicle_pid, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, max(next_ms) AS end_ms, bool_or(next_ms IS NULL) AS open, arg_max(coalesce(next_on, false), (ts_ms, seq)) AS next_on, sum(CASE WHEN first THEN 0.0 ELSE step END) / 3600.0 AS hours FROM z WHERE idle GROUP BY vehicle_pid, run)
SELECT vehicle_pid, start_ms, end_ms, {r('(end_ms - start_ms) / 1000.0', 10)} AS duration_s, {r('1.5 * hours', 10)} AS fuel_l, 0.0::DOUBLE AS energy_kwh, {r('1.5 * hours * 1.45', 10)} AS cost, {r('1.5 * hours * 2.31', 10)} AS co2_kg,
CASE WHEN end_ms - last_ms > 600000 THEN 'GAP' WHEN next_on THEN 'SPEED_RESUME' ELSE 'IGNITION_OFF' END AS reason FROM g WHERE NOT open AND (last_ms - start_ms) / 1000.0 >= 120"""

# Three phases (0 parked, 1 driving, 2 standing with the engine on); these samples always have a place and an ignition.
_FAR = "12742176.0 * asin(sqrt(least(1.0, pow(sin(radians(n.lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(n.lat)) * pow(sin(radians(n.lon - {b}) / 2), 2))))"
ORACLE["st_trip_fsm_py"] = _stepped(
    "SELECT vehicle_pid, ts_ms, seq, lat_e6 / 1e6 AS lat, lon_e6 / 1e6 AS lon, speed_kmh, ignition, row_number() OVER (PARTITION BY vehicle_pid ORDER BY ts_ms, seq) AS rn FROM t",
    "0 AS phase, lat AS llat, lon AS llon, CASE WHEN speed_kmh < 5 THEN lat END AS alat, CASE WHEN speed_kmh < 5 THEN lon END AS alon, CASE WHEN speed_kmh >= 5 THEN ts_ms END AS moving, 0::BIGINT AS start, 0.0::DOUBLE AS km, 0.0::DOUBLE AS idle, NULL::VARCHAR AS reason, 0::BIGINT AS c_start, 0.0::DOUBLE AS c_km, 0.0::DOUBLE AS c_idle",
    "CASE WHEN done THEN 0 WHEN begun OR (phase = 2 AND speed_kmh >= 5) THEN 1 WHEN phase = 1 AND speed_kmh < 1 THEN 2 ELSE phase END, lat, lon, CASE WHEN done OR (phase = 0 AND speed_kmh < 5) THEN lat ELSE alat END, CASE WHEN done OR (phase = 0 AND speed_kmh < 5) THEN lon ELSE alon END, moving2, CASE WHEN begun THEN moving2 ELSE start END, CASE WHEN begun OR done THEN 0.0 ELSE km2 END, CASE WHEN begun OR done THEN 0.0 ELSE idle2 END, CASE WHEN lost THEN 'DATA_GAP' WHEN done THEN 'IGNITION_OFF' END, start, km2, idle2",
    "SELECT *, phase = 0 AND speed_kmh >= 5 AND ((ts_ms - moving2) / 1000.0 >= 10 OR coalesce(away, 0.0) > 50) AS begun, lost OR (phase > 0 AND NOT ignition) AS done, km + CASE WHEN phase = 1 AND NOT lost AND secs > 0 THEN hop / 1000 ELSE 0.0 END AS km2, idle + CASE WHEN phase = 2 THEN secs ELSE 0.0 END AS idle2 FROM (SELECT f.vehicle_pid, n.rn, n.ts_ms, n.seq, n.lat, n.lon, n.speed_kmh, n.ignition, f.phase, f.alat, f.alon, f.start, f.km, f.idle, CASE WHEN f.phase = 0 AND n.speed_kmh >= 5 THEN coalesce(f.moving, n.ts_ms) END AS moving2, (n.ts_ms - f.ts_ms) / 1000.0 AS secs, f.phase = 1 AND n.ts_ms - f.ts_ms > 900000 AS lost, "
    + "CASE WHEN f.alat IS NOT NULL THEN " + _FAR.format(a="f.alat", b="f.alon") + " END AS away, " + _FAR.format(a="f.llat", b="f.llon") + " AS hop FROM f JOIN num n ON n.vehicle_pid = f.vehicle_pid AND n.rn = f.rn + 1)",
    f"SELECT vehicle_pid, c_start AS start_ms, ts_ms AS end_ms, {r('c_km', 6)} AS distance_km, {r('c_idle')} AS idle_s, reason AS end_reason FROM f WHERE reason IS NOT NULL AND (ts_ms - c_start) / 1000.0 >= 30",
)


def _snap_sql() -> str:
    from motorcade.operators.algorithms import grid_graph
    from motorcade.plans.telemetry import haversine_sql

    deg = 500.0 / 111_000.0
    nodes = ", ".join(f"({n}, {lat!r}::DOUBLE, {lon!r}::DOUBLE)" for n, lat, lon in grid_graph(GRID)[0])
    cell = lambda x: f"CAST(trunc({x} / {deg!r}) AS BIGINT)"
    return f"""WITH {TELEMETRY}, n AS (SELECT *, {cell('nlat')} AS ci, {cell('nlon')} AS cj FROM (VALUES {nodes}) x(node, nlat, nlon)),
p AS (SELECT event_id AS point_id, {LAT} AS lat, {LON} - 0.2 AS lon FROM t), q AS (SELECT *, {cell('lat')} AS pi, {cell('lon')} AS pj FROM p),
d AS (SELECT point_id, CAST(node AS INTEGER) AS node, greatest(abs(ci - pi), abs(cj - pj)) AS ring, {haversine_sql('lat', 'lon', 'nlat', 'nlon', 6_371_088.0)} AS m FROM q JOIN n ON abs(ci - pi) <= 3 AND abs(cj - pj) <= 3)
SELECT point_id, node, {r('m')} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ring, m, node) AS k FROM d) WHERE k = 1"""


ORACLE["graph_snap"] = _snap_sql()

_B64 = "rtrim(translate(base64({x}), '+/', '-_'), '=')"
_BODY = "'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.' || " + _B64.format(x="""encode('{"sub":"' || vehicle_pid || '","exp":' || ts_ms // 1000 || '}')""")
ORACLE["p_jwt"] = f"""WITH {TELEMETRY}, b AS (SELECT *, {_BODY} AS body FROM t), s AS (SELECT *, body || '.' || {_B64.format(x="unhex(" + _hmac('body', 'shared key') + ")")} AS good, body || '.' || {_B64.format(x="unhex(" + _hmac('body', 'other key') + ")")} AS forged FROM b),
k AS (SELECT *, CASE WHEN k % 7 = 0 THEN forged WHEN k % 11 = 0 THEN 'e30.x.x' WHEN k % 13 = 0 THEN 'no token' ELSE good END AS token FROM s),
v AS (SELECT event_id, vehicle_pid, CASE WHEN len(string_split(token, '.')) <> 3 THEN 'MALFORMED' WHEN NOT starts_with(token, 'eyJhbGciOiJIUzI1NiI') THEN 'BAD_ALGORITHM' WHEN token <> good THEN 'BAD_SIGNATURE' WHEN ts_ms // 1000 <= {1_704_067_200 + 2000} THEN 'EXPIRED' ELSE 'OK' END AS verdict FROM k)
SELECT event_id, verdict, CASE WHEN verdict = 'OK' THEN vehicle_pid END AS sub FROM v"""


# Charging schedules: 121 levels of half a kilowatt-hour. Forward, each level's least cost and where it came from (ties
# go to the smaller step); backward, what each slot adds on the way to a request's target.
def _schedule_sql(requests: str, slots: int, tail: str) -> str:
    power = "CASE WHEN i * 0.5 / 60.0 <= 0.8 THEN 11.0 ELSE 11.0 * (1 - (i * 0.5 / 60.0 - 0.8) / 0.2 * 0.9) END"
    price = [0.12 if i % 8 < 5 else 0.28 for i in range(slots)]
    parts = [f"q AS ({requests})", f"m AS (SELECT CAST(i AS INTEGER) AS i, least(120 - i, CAST(floor(({power}) * 0.25 * 0.92 / 0.5 + 1e-9) AS INTEGER)) AS reach FROM range(121) x(i))"]
    parts.append("d0 AS (SELECT 30 AS i, 30 AS frm, 0.0::DOUBLE AS c)")
    for s in range(slots):
        step = f"SELECT d.i + CAST(a AS INTEGER) AS i, d.i AS frm, a, c + a * 0.5::DOUBLE / 0.92::DOUBLE * {price[s]}::DOUBLE AS c FROM d{s} d JOIN m ON m.i = d.i CROSS JOIN range(6) x(a) WHERE a <= m.reach"
        parts.append(f"d{s + 1} AS MATERIALIZED (SELECT i, frm, c FROM ({step}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(c, 9), a) = 1)")
    parts.append("g AS (SELECT DISTINCT least(120, CAST(round_even(target / 0.5, 0) AS INTEGER)) AS goal FROM q)")
    parts.append(f"b{slots} AS (SELECT goal, coalesce(min(i) FILTER (i >= goal), max(i)) AS i, max(i) >= goal AS feasible FROM g, d{slots} GROUP BY goal)")
    parts += [f"b{s} AS (SELECT b.goal, d.frm AS i FROM b{s + 1} b JOIN d{s + 1} d ON d.i = b.i)" for s in range(slots - 1, -1, -1)]
    added = " UNION ALL ".join(f"SELECT x.goal, {s + 1} AS slot, {price[s]}::DOUBLE AS price, (y.i - x.i) * 0.5::DOUBLE AS kwh FROM b{s} x JOIN b{s + 1} y ON y.goal = x.goal" for s in range(slots))
    parts.append(f"k AS ({added})")
    base = ["p0 AS (SELECT request_id, 15.0::DOUBLE AS e, target, 0.0::DOUBLE AS cost FROM q)"]
    base += [f"p{s + 1} AS (SELECT request_id, e + ({_add}) AS e, target, cost + ({_add}) / 0.92 * {price[s]} AS cost FROM p{s})" for s in range(slots)]
    cost, paid = r("d.c", 4), r("p.cost", 4)
    rows = f"""z AS (SELECT q.request_id, CAST(k.slot AS INTEGER) AS slot, k.price, k.kwh, {cost} AS cost, {paid} AS baseline, {r('greatest(0.0, p.cost - d.c)', 4)} AS saving, b.feasible
  FROM q JOIN p{slots} p USING (request_id) JOIN b{slots} b ON b.goal = least(120, CAST(round_even(q.target / 0.5, 0) AS INTEGER)) JOIN d{slots} d ON d.i = b.i JOIN k ON k.goal = b.goal)"""
    return "WITH " + ", ".join([*parts, *base, rows]) + " " + tail


_REQUESTS = "SELECT CAST(c_custkey AS VARCHAR) AS request_id, CAST(least(55.0, 15.0 + abs(c_acctbal) / 400.0) AS DOUBLE) AS target FROM customer"
ORACLE["dp_charging"] = _schedule_sql(_REQUESTS, 24, "SELECT * FROM z")
ORACLE["q_ev_plan"] = _schedule_sql(_REQUESTS + " WHERE c_custkey = 1", 24, "SELECT * FROM z")
ORACLE["plan_ev_api"] = _schedule_sql("SELECT 'r' AS request_id, 48.0::DOUBLE AS target", 48, "SELECT * EXCLUDE (request_id) FROM z")

# Beta(2, 5) as the second smallest of six keyed uniforms.
_UNIFORMS = ", ".join(f"(CAST('0x' || substr(md5('{i}:' || vehicle_pid), 1, 7) AS BIGINT) + 0.5) / {float(1 << 28)!r}::DOUBLE" for i in range(6))
ORACLE["gen_driver_profile"] = f"WITH {TELEMETRY} SELECT vehicle_pid, list_sort([{_UNIFORMS}])[2] AS aggression FROM (SELECT DISTINCT vehicle_pid FROM t)"

# As many facts of each kind as their own queries have.
_FACTS = {"trip": "st_trip_fsm", "idle": "st_idle", "charging": "st_charging", "safety": "st_safety"}
ORACLE["sink_fact_insert"] = " UNION ALL ".join(f"SELECT '{kind}' AS fact, count(*) AS rows FROM ({ORACLE[name]})" for kind, name in _FACTS.items())

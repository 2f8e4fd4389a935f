"""Optimisation kernels: two-state labelling, charging schedules, depot allocation, energy routing, components.

Each handles one vehicle, request, depot or graph at a time in memory; DataFrames carry the many."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorcade.checkpoints import ensure, folder
from motorcade.functions.geo import metres

# labelling ---------------------------------------------------------------------------------------


def viterbi(speeds: list[float], theta: float = 5.0, penalty: float = 8.0) -> list[str]:
    """Labels MOVING or STOPPED of least total cost: misfit to the threshold plus a penalty per change; ties go to MOVING."""
    cost, back = None, []
    for v in speeds:
        fit = (((theta - v) / theta) ** 2 if v < theta else 0.0, min(1.0, (v / theta) ** 2))
        if cost is None:
            cost = list(fit)
            continue
        came = (0 if cost[0] <= cost[1] + penalty else 1, 0 if cost[0] + penalty <= cost[1] else 1)
        back.append(came)
        cost = [cost[came[0]] + penalty * (came[0] != 0) + fit[0], cost[came[1]] + penalty * (came[1] != 1) + fit[1]]
    if cost is None:
        return []
    path = [0 if cost[0] <= cost[1] else 1]
    for came in reversed(back):
        path.append(came[path[-1]])
    return [("MOVING", "STOPPED")[x] for x in reversed(path)]


def labelled(telemetry: DataFrame, day_ms: int = 86_400_000) -> DataFrame:
    """vehicle_pid, ts_ms, seq, label; a vehicle's history is labelled day by day, which bounds a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "seq"])
        return pdf[["vehicle_pid", "ts_ms", "seq"]].assign(label=viterbi(pdf["speed_kmh"].fillna(0).tolist()))

    rows = telemetry.select("vehicle_pid", "ts_ms", "seq", F.col("speed_kmh").cast("double"), F.floor(F.col("ts_ms") / day_ms).alias("day"))
    return rows.groupBy("vehicle_pid", "day").applyInPandas(run, "vehicle_pid string, ts_ms bigint, seq bigint, label string")


# charging ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    slot_kwh: list[float]
    cost: float
    baseline: float
    saving: float
    feasible: bool
    reached_kwh: float


def charge_power(kwh: float, most_kwh: float, kw: float, taper: float = 0.8, end: float = 0.1) -> float:
    """Power at a state of charge: full up to the taper, then linear to `end` of it at 100 %."""
    soc = kwh / most_kwh if most_kwh > 0 else 1.0
    return kw if soc <= taper else kw * (1 - (soc - taper) / (1 - taper) * (1 - end))


def baseline_cost(e0: float, target: float, most: float, prices: list[float], kw: float, hours: float = 0.25, eta: float = 0.92) -> float:
    """Cost of charging at once at full power."""
    e, total = e0, 0.0
    for p in prices:
        if e >= target:
            break
        added = min(charge_power(e, most, kw) * hours * eta, target - e, most - e)
        total, e = total + added / eta * p, e + added
    return total


@lru_cache(maxsize=64)
def charging_table(start: int, most: float, prices: tuple[float, ...], kw: float, step: float, hours: float, eta: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost of each level of the energy grid after all slots, and by slot the level that each was reached from.
    It doesn't depend on the target, so requests that differ in nothing else share it."""
    n = math.ceil(most / step) + 1
    reach = np.array([min(n - 1 - i, math.floor(charge_power(i * step, most, kw) * hours * eta / step + 1e-9)) for i in range(n)])
    levels, can = np.arange(n), {a: reach[: n - a] >= a for a in range(1, max(reach, default=0) + 1)}
    f = np.full(n, np.inf)
    f[start], came = 0.0, []
    for p in prices:
        g, frm = f.copy(), levels.copy()
        for a, ok in can.items():
            cost = np.where(ok, f[: n - a] + a * step / eta * p, np.inf)
            less = cost < g[a:] - 1e-12
            g[a:][less], frm[a:][less] = cost[less], levels[: n - a][less]
        f = g
        came.append(frm)
    return f, came


@lru_cache(maxsize=4096)
def schedule(start: int, goal: int, most: float, prices: tuple[float, ...], kw: float, step: float, hours: float, eta: float) -> tuple[tuple[float, ...], float, bool, int]:
    """Energy by slot, cost, whether the goal is reached, and the level reached."""
    f, came = charging_table(start, most, prices, kw, step, hours, eta)
    ok = np.flatnonzero(np.isfinite(f[goal:])) + goal
    best = int(ok[np.argmin(f[ok])]) if len(ok) else int(np.flatnonzero(np.isfinite(f)).max())
    slots, at = [0.0] * len(prices), best
    for i in range(len(prices) - 1, -1, -1):
        slots[i] = float((at - came[i][at]) * step)
        at = int(came[i][at])
    return tuple(slots), float(f[best]), len(ok) > 0, best


def charging_plan(e0: float, target: float, most: float, prices: list[float], charger_kw: float, vehicle_kw: float, step: float = 0.5, hours: float = 0.25, eta: float = 0.92) -> Plan:
    """Cheapest schedule over slots by dynamic programming on an energy grid: the least cost over all levels at or above
    the target; if none is reachable, the highest level that is."""
    kw, n = min(charger_kw, vehicle_kw), math.ceil(most / step) + 1
    start, goal = (max(0, min(n - 1, round(e / step))) for e in (e0, target))
    slots, cost, feasible, best = schedule(start, goal, most, tuple(prices), kw, step, hours, eta)
    base = baseline_cost(e0, target, most, prices, kw, hours, eta)
    return Plan(list(slots), round(cost, 4), round(base, 4), round(max(0.0, base - cost), 4), feasible, best * step)


PLAN_SCHEMA = "request_id string, slot int, price double, kwh double, cost double, baseline double, saving double, feasible boolean"


def charging_plans(requests: DataFrame) -> DataFrame:
    """One row per request and slot. requests: request_id, e0_kwh, target_kwh, max_kwh, charger_kw, vehicle_kw, prices (array)."""

    names = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            prices = [tuple(map(float, x)) for x in pdf["prices"]]
            plans = [charging_plan(*x) for x in zip(pdf["e0_kwh"], pdf["target_kwh"], pdf["max_kwh"], prices, pdf["charger_kw"], pdf["vehicle_kw"], strict=True)]
            times = [len(x) for x in prices]
            flat = lambda xs, kind: np.fromiter((v for x in xs for v in x), kind, sum(times))
            each = {c: np.repeat(np.array([getattr(p, c) for p in plans]), times) for c in names[4:]}
            slots = flat((range(1, n + 1) for n in times), np.int32)
            yield pd.DataFrame({"request_id": np.repeat(pdf["request_id"].to_numpy(), times), "slot": slots, "price": flat(prices, float), "kwh": flat((p.slot_kwh for p in plans), float), **each})[names]

    # few bytes but much work per request: dealt over as many tasks as a shuffle has, which a size-based split wouldn't do
    spark = requests.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return requests.repartition(tasks, "request_id").mapInPandas(run, PLAN_SCHEMA)


def price_slots(n: int = 48) -> Column:
    """Prices of 15-minute slots: five cheap and three dear in turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 8 < 5, 0.12).otherwise(0.28))


def slack(e0: Column, target: Column, charger_kw: Column, vehicle_kw: Column, slots: Column, hours: float = 0.25, eta: float = 0.92) -> Column:
    """Slots to spare: those at hand less the fewest that the energy needs."""
    need = F.greatest(F.lit(0.001), target - e0)
    return slots - F.ceil(need / (F.least(charger_kw, vehicle_kw) * hours * eta))


DEPOT_SCHEMA = "depot_id bigint, request_id string, slot int, kwh double, feasible boolean"


def allocate_depots(requests: DataFrame, cap_kw: float, prices: list[float], hours: float = 0.25, eta: float = 0.92) -> DataFrame:
    """Vehicles of a depot in order of least slack, each planned against the least power left over its stay.
    requests: depot_id, request_id, e0_kwh, target_kwh, max_kwh, charger_kw, vehicle_kw, slots. A depot's stalls bound its group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = [cap_kw] * len(prices), []
        need = (pdf["target_kwh"] - pdf["e0_kwh"]).clip(lower=0.001)
        power = pdf[["charger_kw", "vehicle_kw"]].min(axis=1) * hours * eta
        order = pdf.assign(_s=pdf["slots"] - np.ceil(need / power)).sort_values(["_s", "request_id"])
        for r in order.itertuples():
            stay = left[: r.slots]
            plan = charging_plan(r.e0_kwh, r.target_kwh, r.max_kwh, prices[: r.slots], min([r.charger_kw, *stay]) if stay else 0.0, r.vehicle_kw, hours=hours, eta=eta)
            for i, k in enumerate(plan.slot_kwh):
                left[i] = max(0.0, left[i] - k / eta / hours)
                out.append((r.depot_id, r.request_id, i + 1, k, plan.feasible))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DEPOT_SCHEMA.split(", ")])

    return requests.groupBy("depot_id").applyInPandas(run, DEPOT_SCHEMA)


# routing -----------------------------------------------------------------------------------------

#: Energy scales of bodies, and kWh per km at a speed.
BODY = {"SEDAN": 1.0, "VAN": 1.5, "BUS": 4.0, "TRUCK": 4.5}
PER_KM, PER_KM_V2, BEST_KMH = 0.15, 0.00003, 50.0


def edge_energy(km: Column, kmh: Column, body: str = "SEDAN") -> Column:
    return km * BODY.get(body, 1.0) * (PER_KM + PER_KM_V2 * (kmh - BEST_KMH) * (kmh - BEST_KMH))


class Graph:
    """Adjacency of a road graph small enough for one process; edges: (src, dst, km, kmh)."""

    def __init__(self, nodes: list[tuple[int, float, float]], edges: list[tuple[int, int, float, float]]):
        self.at = {i: (lat, lon) for i, lat, lon in nodes}
        self.out: dict[int, list] = {}
        self.into: dict[int, list] = {}
        for s, d, km, kmh in edges:
            self.out.setdefault(s, []).append((d, km, max(kmh, 1.0)))
            self.into.setdefault(d, []).append((s, km, max(kmh, 1.0)))

    @staticmethod
    def cost(km: float, kmh: float, weight: str, body: str) -> float:
        return km / kmh if weight == "time" else km * BODY.get(body, 1.0) * (PER_KM + PER_KM_V2 * (kmh - BEST_KMH) ** 2)

    def search(self, sources: list[int], weight: str = "energy", body: str = "SEDAN", budget: float = math.inf, goal: int | None = None, reverse: bool = False, guide: bool = False) -> tuple[dict, dict]:
        """Least cost and predecessor of each node reached from the nearest source within the budget; with guide, towards
        the goal by a bound from straight-line energy."""
        step = self.into if reverse else self.out
        if guide and goal is not None:
            rate, end = BODY.get(body, 1.0) * PER_KM / 1000, self.at[goal]
            ahead = lambda n: float(metres(*self.at[n], *end, 6_371_088.0)) * rate
        else:
            ahead = lambda n: 0.0
        dist, came, done = dict.fromkeys(sources, 0.0), {}, set()
        heap = [(ahead(s), s) for s in sorted(set(sources))]
        while heap:
            _, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u == goal:
                break
            if dist[u] > budget:
                continue
            for v, km, kmh in step.get(u, ()):
                d = dist[u] + self.cost(km, kmh, weight, body)
                if d < dist.get(v, math.inf):
                    dist[v], came[v] = d, u
                    heapq.heappush(heap, (d + ahead(v), v))
        return dist, came

    def path(self, src: int, dst: int, body: str = "SEDAN", guide: bool = True) -> tuple[float, list[int]]:
        if dst not in self.at or src not in self.at:
            return math.inf, []
        dist, came = self.search([src], body=body, goal=dst, guide=guide)
        if dst not in dist:
            return math.inf, []
        out = [dst]
        while out[-1] != src:
            out.append(came[out[-1]])
        return dist[dst], out[::-1]

    def reachable(self, src: int, usable_kwh: float, chargers: list[int], body: str = "SEDAN", k: int = 5) -> list[tuple[int, float]]:
        dist, _ = self.search([src], body=body, budget=usable_kwh)
        return sorted(((c, dist[c]) for c in chargers if dist.get(c, math.inf) < usable_kwh), key=lambda x: (x[1], x[0]))[:k]


def relaxed(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(node, dist): least energy to the nearest source against edge direction, after at most `rounds` edges. For graphs
    that don't fit one process: each round is a join and a minimum; it ends early when nothing changes.

    edges: src, dst, kwh; sources: node."""
    ensure(edges.sparkSession)
    dist = sources.select("node", F.lit(0.0).alias("dist")).distinct()
    for _ in range(rounds):
        step = edges.join(dist, edges["dst"] == dist["node"]).select(F.col("src").alias("node"), (F.col("kwh") + F.col("dist")).alias("dist"))
        new = dist.unionByName(step).groupBy("node").agg(F.min("dist").alias("dist")).checkpoint()
        same = new.agg(F.count("*"), F.sum("dist")).first() == dist.agg(F.count("*"), F.sum("dist")).first()
        dist = new
        if same:
            break
    return dist


#: Rows of nodes by cell that are few enough to broadcast, some megabytes.
FEW_NEAR = 100_000


def snapped(points: DataFrame, nodes: DataFrame, cell_m: float = 500.0, rings: int = 3) -> DataFrame:
    """Nearest node of each point among the first non-empty ring of grid cells. points: point_id, lat, lon; nodes: node, lat, lon.

    Nodes are dealt to the cells around theirs, and a cell keeps those of its first ring; points stay one row each. They
    are never broadcast: their size is estimated from compressed files, which may hold many times what they take."""
    from motorcade.functions.geo import haversine

    spark, deg = points.sparkSession, cell_m / 111_000.0
    cell = lambda c: F.expr(f"cast({c} / {deg!r} as int)")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(max(abs(i), abs(j))).alias("ring")) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)]))
    n = nodes.select("node", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), cell("lat").alias("ci"), cell("lon").alias("cj"), around.alias("o"))
    n = n.select("node", "nlat", "nlon", (F.col("ci") - F.col("o.di")).alias("pi"), (F.col("cj") - F.col("o.dj")).alias("pj"), "o.ring")
    n = n.withColumn("first", F.min("ring").over(Window.partitionBy("pi", "pj"))).where("ring = first").drop("first")
    path = folder(spark, "near")
    n.write.parquet(path)
    near = spark.read.schema(n.schema).parquet(path)
    p = points.select("point_id", "lat", "lon", cell("lat").alias("pi"), cell("lon").alias("pj"))
    few = near.limit(FEW_NEAR + 1).count() <= FEW_NEAR
    met = p.join(F.broadcast(near), ["pi", "pj"]) if few else p.hint("merge").join(near.hint("merge"), ["pi", "pj"])
    d = haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"), 6_371_088.0)
    best = met.withColumn("distance_m", d).groupBy("point_id").agg(F.min_by(F.struct("node", "distance_m"), F.struct("ring", "distance_m", "node")).alias("b"))
    return best.select("point_id", "b.node", "b.distance_m")


def grid_graph(n: int, south: float = 13.0, west: float = 80.0, step: float = 0.005) -> tuple[list, list]:
    """A square grid of streets, for examples and tests."""
    nodes = [(r * n + c, south + r * step, west + c * step) for r in range(n) for c in range(n)]
    edges = []
    for r in range(n):
        for c in range(n):
            for rr, cc in ((r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)):
                if 0 <= rr < n and 0 <= cc < n:
                    a, b = r * n + c, rr * n + cc
                    km = float(metres(*nodes[a][1:], *nodes[b][1:], 6_371_088.0)) / 1000
                    edges.append((a, b, km, 30.0 + 10 * ((a + b) % 5)))
    return nodes, edges


# components --------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), by spreading minima with shortcuts."""
    ensure(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        hop = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = new.join(hop, "component").select("node", F.col("up").alias("component")).checkpoint()
        if new.join(label, ["node", "component"], "left_anti").isEmpty():
            return new
        label = new
    return label


def adjacent_cells(cells: DataFrame, precision: int = 7) -> DataFrame:
    """Pairs of listed map cells that touch."""
    from motorcade.functions.geo import geohash_neighbours

    near = cells.select(F.col("cell").alias("a"), F.explode(geohash_neighbours(F.col("cell"), precision)).alias("b"))
    return near.join(cells.select(F.col("cell").alias("b")), "b").where("a < b").select("a", "b")


def running(order: list[str], partition: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

"""Deduplication, reordering and GPS plausibility of per-vehicle streams in arrival order."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorcade.config import CLOCK_SKEW, LATE, REORDER, ReorderConfig
from motorcade.functions.geo import metres
from motorcade.operators.lockstep import Arrays, run


def first_arrivals(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The earliest arrival of each key: exact deduplication."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(arrival)).alias("r"))
    return best.select("r.*")


def judged(df: DataFrame, arrival: str, size: int = 4096) -> DataFrame:
    """vehicle_pid, seq, arrival and verdict of a window over the last `size` sequence numbers: OUT_OF_WINDOW that many or
    more behind the greatest that came before, else DUPLICATE where the number came before, else NEW."""
    rows = df.select("vehicle_pid", "seq", F.col(arrival).cast("bigint").alias("arrival"))
    before = Window.partitionBy("vehicle_pid").orderBy("arrival", "seq").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("vehicle_pid", "seq").orderBy("arrival")
    rows = rows.withColumn("behind", F.max("seq").over(before) - F.col("seq")).withColumn("times", F.row_number().over(same))
    verdict = F.when(F.col("behind") >= size, "OUT_OF_WINDOW").when(F.col("times") > 1, "DUPLICATE").otherwise("NEW")
    return rows.select("vehicle_pid", "seq", "arrival", verdict.alias("verdict"))


@dataclass
class Mark:
    """Greatest time that arrived and greatest that was let go, or -1."""

    top: int = -1
    gone: int = -1


def released(ts: np.ndarray, seq: np.ndarray, held: int, mark: Mark, c: ReorderConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, Mark]:
    """What a vehicle's buffer does with arrivals ts[held:], seq[held:] while it holds the ones before: numbers of the events
    that leave, in order, of late ones, and of those that stay.

    An event leaves when the watermark (the greatest time less the lateness) reaches it; one at or before a time that
    has left is late. All of that follows from running maxima, but for arrivals that overfill the buffer."""
    n = len(ts) - held
    arrival = np.concatenate([np.full(held, -1), np.arange(n)])
    top = np.maximum.accumulate(np.append(mark.top, ts[held:]))[1:]
    leaves = np.maximum(arrival, np.searchsorted(top, ts + c.lateness_ms))  # n: stays
    gone = np.full(n + 1, mark.gone)
    out = leaves < n
    np.maximum.at(gone, leaves[out] + 1, ts[out])
    gone = np.maximum.accumulate(gone)
    late = np.zeros(len(ts), bool)
    late[held:] = ts[held:] <= gone[:n]
    inside = held + np.cumsum(~late[held:]) - np.cumsum(np.bincount(leaves[out & ~late], minlength=n)[:n])
    if n and inside.max() > c.capacity:
        return _overfilled(ts, seq, held, mark, c)
    left = np.flatnonzero(out & ~late)
    left = left[np.lexsort((seq[left], ts[left]))]
    return left, np.flatnonzero(late), np.flatnonzero(~out & ~late), Mark(int(top[-1]) if n else mark.top, int(gone[-1]))


def _overfilled(ts: np.ndarray, seq: np.ndarray, held: int, mark: Mark, c: ReorderConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, Mark]:
    """The same, arrival by arrival: a full buffer lets its earliest event go."""
    times, numbers = ts.tolist(), seq.tolist()
    inside = sorted((times[i], numbers[i], i) for i in range(held))
    left, late, top, gone = [], [], mark.top, mark.gone
    for i in range(held, len(times)):
        if times[i] <= gone:
            late.append(i)
            continue
        top = max(top, times[i])
        insort(inside, (times[i], numbers[i], i))
        cut = 0
        while cut < len(inside) and (inside[cut][0] <= top - c.lateness_ms or len(inside) - cut > c.capacity):
            cut += 1
        if cut:
            gone = inside[cut - 1][0]
            left += [x[2] for x in inside[:cut]]
            del inside[:cut]
    as_numbers = lambda x: np.array(x, np.int64)
    return as_numbers(left), as_numbers(late), as_numbers([x[2] for x in inside]), Mark(top, gone)


REORDERED = "vehicle_pid string, ts_ms bigint, seq bigint, quality int, route string, position bigint"


def reordered(df: DataFrame, arrival: str, c: ReorderConfig = REORDER) -> DataFrame:
    """vehicle_pid, ts_ms, seq, quality, route (clean or late) and position: what leaves each vehicle's buffer, in that
    order; the rest is flushed at the end, as for a silent vehicle. An event more than skew_ms ahead of its arrival is flagged.

    One shuffle; a task holds a batch and one vehicle's buffer."""
    came = F.col(arrival).cast("bigint")
    quality = F.coalesce(F.col("quality"), F.lit(0)) if "quality" in df.columns else F.lit(0)
    skewed = F.when(F.col("ts_ms") > came + c.skew_ms, CLOCK_SKEW).otherwise(0)
    rows = df.where("vehicle_pid is not null").select("vehicle_pid", F.col("ts_ms").cast("bigint").alias("ts_ms"), F.col("seq").cast("bigint").alias("seq"), quality.cast("int").bitwiseOR(skewed).alias("quality"), came.alias("arrival"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vehicle, mark, place = None, Mark(), 0
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)]
        out: list[tuple] = []  # vehicle, time, number, quality, late, position

        def put(cols, late) -> None:
            nonlocal place
            if len(cols[0]):
                out.append((vehicle, *cols, np.full(len(cols[0]), late), np.arange(place + 1, place + 1 + len(cols[0]))))
                place += 0 if late else len(cols[0])

        def flush() -> None:
            order = np.lexsort((held[1], held[0]))
            put([x[order] for x in held], False)

        def batch() -> pa.RecordBatch:
            size = [len(x[1]) for x in out]
            late = np.concatenate([x[4] for x in out])
            who = pa.array([x[0] for x in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), size)))
            ts, seq, q, position = (np.concatenate([x[i] for x in out]) for i in (1, 2, 3, 5))
            route = pa.array(["clean", "late"]).take(pa.array(late.astype(np.int8)))
            cols = [who, pa.array(ts), pa.array(seq), pa.array((q | np.where(late, LATE, 0)).astype(np.int32)), route, pa.array(position, mask=late)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in REORDERED.split(", ")])

        for b in batches:
            names = b.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            cols = [b.column(i).to_numpy() for i in (1, 2, 3)]
            for lo, hi in zip(starts, np.append(starts[1:], len(code)), strict=True):
                name = names.dictionary[int(code[lo])].as_py()
                if name != vehicle:
                    flush()
                    vehicle, mark, place = name, Mark(), 0
                    held = [x[:0] for x in held]
                both = [np.concatenate([x, y[lo:hi]]) for x, y in zip(held, cols, strict=True)]
                left, late, stay, mark = released(both[0], both[1], len(held[0]), mark, c)
                put([x[left] for x in both], False)
                put([x[late] for x in both], True)
                held = [x[stay] for x in both]
            if out:
                yield batch()
        flush()
        if out:
            yield batch()

    return rows.repartition("vehicle_pid").sortWithinPartitions("vehicle_pid", "arrival", "seq").select("vehicle_pid", "ts_ms", "seq", "quality").mapInArrow(go, REORDERED)


def late_flags(df: DataFrame, arrival: str, c: ReorderConfig = REORDER) -> DataFrame:
    """Lateness in window functions alone, without the buffer's capacity: an event is late if one that arrived before it
    had already moved the vehicle's watermark to or past an emitted time at or after its own."""
    w = Window.partitionBy("vehicle_pid").orderBy(arrival, "seq").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max("ts_ms").over(w) - c.lateness_ms
    return df.withColumn("watermark_ms", mark).withColumn("behind", F.coalesce(F.col("ts_ms") <= mark, F.lit(False)))


class GpsMachine:
    """Suspect is a point whose speed from the last trusted one is past the limit, until enough suspects in a row lie around
    their mean: then the vehicle has moved. Points no later than the trusted one are neither judged nor counted."""

    columns, schema = ("ts_ms", "lat", "lon", "speed_kmh"), "suspect boolean"
    start = {"ts_ms": -1, "lat": np.nan, "lon": np.nan, "n": 0, "lat_sum": 0.0, "lon_sum": 0.0}
    radius = 6_371_008.8

    def __init__(self, most_kmh: float = 250.0, factor: float = 3.0, confirm: int = 3, around_m: float = 100.0):
        self.most_kmh, self.factor, self.confirm, self.around_m = most_kmh, factor, confirm, around_m

    def step(self, state: Arrays, row: Arrays) -> tuple[Arrays, Arrays]:
        first, hours = state["ts_ms"] < 0, (row["ts_ms"] - state["ts_ms"]) / 3_600_000
        judged = ~first & (hours > 0)
        kmh = metres(state["lat"], state["lon"], row["lat"], row["lon"], self.radius) / 1000 / np.where(judged, hours, 1.0)
        reported = np.nan_to_num(row["speed_kmh"].astype(float))
        odd = judged & (kmh > np.where(reported >= 2, np.maximum(self.most_kmh, self.factor * reported), self.most_kmh))
        n = state["n"] + odd
        lat_sum, lon_sum = state["lat_sum"] + np.where(odd, row["lat"], 0.0), state["lon_sum"] + np.where(odd, row["lon"], 0.0)
        many = np.maximum(n, 1)
        moved = odd & (n >= self.confirm) & (metres(lat_sum / many, lon_sum / many, row["lat"], row["lon"], self.radius) <= self.around_m)
        trusted = first | moved | (judged & ~odd)
        new = {k: np.where(trusted, row[k], state[k]) for k in ("ts_ms", "lat", "lon")}
        new |= {"n": np.where(trusted, 0, n), "lat_sum": np.where(trusted, 0.0, lat_sum), "lon_sum": np.where(trusted, 0.0, lon_sum)}
        return new, {"when": np.ones_like(odd), "suspect": odd & ~moved}


def gps_filtered(telemetry: DataFrame) -> DataFrame:
    """vehicle_pid, ts_ms, seq, suspect."""
    rows = telemetry.where("lat_e6 is not null and lon_e6 is not null").withColumn("lat", F.col("lat_e6") / 1e6).withColumn("lon", F.col("lon_e6") / 1e6)
    return run(rows, "vehicle_pid", ["ts_ms", "seq"], GpsMachine(), ["vehicle_pid", "ts_ms", "seq"])


def bloom_seen(df: DataFrame, group: list[str], key: str, arrival: str, rotate_ms: int, expected: int, error: float) -> DataFrame:
    """The rows with `seen`: whether a Bloom filter of the group's current or last rotation, sized for `expected` keys at an
    error rate, held the key when the row arrived. Never false for a key that came in those rotations before."""
    m = max(8, math.ceil(-expected * math.log(error) / math.log(2) ** 2))
    k = max(1, round(m / expected * math.log(2)))
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(m)), F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(m)).bitwiseOR(F.lit(1))
    bits = F.array_distinct(F.array(*[F.pmod(h1 + h2 * i, F.lit(m)).cast("int") for i in range(k)]))
    turn = F.floor(F.col(arrival) / rotate_ms)
    rows = df.withColumn("_row", F.struct(*df.columns)).select("_row", *group, turn.alias("_turn"), F.col(arrival).alias("_at"), F.explode(bits).alias("_bit"))
    own = F.min("_at").over(Window.partitionBy(*group, "_bit", "_turn"))
    last = F.max("_turn").over(Window.partitionBy(*group, "_bit").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_own", own < F.col("_at")).withColumn("_last", F.coalesce(last == F.col("_turn") - 1, F.lit(False)))
    return rows.groupBy("_row", "_at").agg((F.every("_own") | F.every("_last")).alias("seen")).select("_row.*", "seen")

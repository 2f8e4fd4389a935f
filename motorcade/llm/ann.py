"""Approximate nearest neighbours by adaptive dimension scan of probed lists.

Vectors are rotated by a random orthogonal matrix and assigned to the nearest of about as many centres as the root of
their number; rotation and centres come from a bounded sample, but every row is indexed. A query probes the lists
nearest to it: as few as hold RECALL of the true neighbours of sample vectors among the sample, which lie farther
apart than neighbours in the whole table, and more where those hold fewer than k other ids. Within a list candidates are scanned in column blocks: after t of d rotated
dimensions a candidate is given up if its partial squared distance exceeds the k-th best one times t/d by more than a
hypothesis test at EPSILON allows. Distances of the rest are exact, in double precision on the original vectors.

A list's vectors and the queries that probe it are dealt into blocks of about BLOCK rows, so neither a hot list nor a
common vector meets in one task, and a task holds two blocks. No limit is set on candidates.

Edge cases: vectors that are null, all zero or of another length than most, or that hold a null or non-finite
component, neither search nor are found; ties go to the smaller id; with fewer than k candidates all are returned;
a query is never its own neighbour (by id); rows that repeat an id stand for one neighbour, by their nearest vector,
and one query, by their vector nearest to each; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorcade.llm.common import written

#: Bound on the numbers of the sample that rotation, centres and probes are fitted on: 131,072 rows of 64 dimensions.
MAX_FIT = 1 << 23
ROWS_PER_CENTRE = 64
#: Share of true neighbours that the probed lists must hold, and the sample vectors it is measured on.
RECALL = 0.96
TRIALS = 256
EPSILON = 3.0
COLUMNS = 16
BLOCK = 4096


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray

    probes: int


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & plain & F.exists(v, lambda x: x != 0.0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def build(rows: DataFrame, k: int = 10, most: int = MAX_FIT) -> Index | None:
    whole = rows.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("d")).first()
    if not whole["n"]:
        return None
    n, d = whole["n"], whole["d"]
    size = min(n, most // d + 1, ROWS_PER_CENTRE * (int(n**0.5) + 1))
    sample = rows.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id").limit(size).select("v").toArrow()
    x = np.unique(_matrix(sample["v"], d), axis=0)  # copies would pass for near neighbours
    rng = np.random.default_rng(11)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = x @ rotation
    lists = max(1, min(int(n**0.5), len(x) // ROWS_PER_CENTRE))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(12):
        near = nearest_centre(x, centres)
        held = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres)
    return Index(rotation, centres, _probes(x, centres, k, rng))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])


def _probes(x: np.ndarray, centres: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """How many of the nearest lists hold RECALL of the k nearest others of some vectors of the sample."""
    trials = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    own = nearest_centre(x, centres)
    at = np.argsort(np.argsort(_square(x[trials], centres), axis=1, kind="stable"), axis=1)
    places = []
    for i, ranks in zip(trials, at, strict=True):
        far = _square(x[i : i + 1], x)[0]
        far[i] = np.inf
        places.append(ranks[own[np.argsort(far, kind="stable")[: min(k, len(x) - 1)]]])
    places = np.sort(np.concatenate(places))
    return int(places[min(len(places) - 1, int(RECALL * len(places)))]) + 1 if len(places) else 1


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def assigned(rows: DataFrame, index: Index, probes: int, held: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """(list, id, v) with one row for each of the nearest `probes` lists and, while those hold fewer than `least` ids
    (`held` by list), for the next ones."""
    d = len(index.rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _matrix(part.column(1), d) @ index.rotation
                far = _square(x, index.centres)
                near = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < far.shape[1] else np.broadcast_to(np.arange(probes), far.shape)
                sizes, near = np.full(len(x), near.shape[1]), list(near)
                for i in np.flatnonzero(held[np.stack(near)].sum(1) < least) if held is not None and near else ():
                    order = np.argsort(far[i], kind="stable")
                    near[i] = order[: int(np.searchsorted(held[order].cumsum(), least)) + 1]
                    sizes[i] = len(near[i])
                take = pa.array(np.repeat(np.arange(len(x)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near).astype(np.int32)), part.column(0).take(take), part.column(1).take(take)], ["list", "id", "v"])

    return rows.where(F.size("v") == d).select("id", "v").mapInArrow(run, "list int, id long, v array<double>")


def scan(queries: np.ndarray, q_ids: np.ndarray, found: np.ndarray, f_ids: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its id, ids and exact distances of its k nearest among `found`, an id by its nearest row."""
    d = found.shape[1]
    repeated = len(np.unique(f_ids)) < len(f_ids)

    def best_of(ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, dist))
        if repeated:
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        return ids[order[:k]], dist[order[:k]]

    turned = found @ rotation
    cuts = [*range(COLUMNS, d, COLUMNS)]
    for q, qid, qt in zip(queries, q_ids, queries @ rotation, strict=True):
        others = np.flatnonzero(f_ids != qid)
        first = others[: 4 * k]
        dist = np.sqrt(((found[first] - q) ** 2).sum(1))
        ids, dist = best_of(f_ids[first], dist)
        at, chunk = len(first), 512
        while at < len(others):
            alive = others[at : at + chunk]
            at += chunk
            chunk = min(2 * chunk, 4096)
            far = dist[-1] ** 2 if len(dist) == k else np.inf
            part, done = np.zeros(len(alive)), 0
            for t in cuts:
                part = part + ((turned[alive, done:t] - qt[done:t]) ** 2).sum(1)
                done = t
                ok = part <= far * (t / d) * (1 + EPSILON / np.sqrt(t)) ** 2
                if not ok.all():
                    alive, part = alive[ok], part[ok]
                if not len(alive):
                    break
            if len(alive):
                new = np.sqrt(((found[alive] - q) ** 2).sum(1))
                ids, dist = best_of(np.concatenate([ids, f_ids[alive]]), np.concatenate([dist, new]))
        yield int(qid), ids, dist


def _held(table: DataFrame, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and different ids of each list; there are as many lists as the index has centres."""
    rows, ids = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in table.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect():
        rows[r["list"]], ids[r["list"]] = r["n"], r["ids"]
    return rows, ids


def _blocks(rows: np.ndarray) -> Column:
    """Number of blocks of a row's list."""
    return F.get(F.array(*[F.lit(int(-(-n // BLOCK))) for n in rows]), F.col("list"))


def search(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found for each row whose id is divisible by `every`: query_id, rank, the neighbour's id, score."""
    spark = df.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = usable(df, id_col, vec_col)
    index = build(rows, k)
    if index is None:
        return spark.createDataFrame([], schema)
    d, rotation = len(index.rotation), index.rotation
    # distinct: rows that repeat an id and its vector stand once, else copies take the places of other rows in a block
    stored = written(assigned(rows.distinct(), index, 1), "lists")
    lists = len(index.centres)
    n_rows, n_ids = _held(stored, lists)
    asked = written(assigned(rows.where(F.col("id") % every == 0).distinct(), index, index.probes, n_ids, k + 1), "probes")
    n_stored, n_asked = _blocks(n_rows), _blocks(_held(asked, lists)[0])
    other = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = asked.withColumn("qb", own(n_asked)).withColumn("fb", other(n_stored))
    right = stored.withColumn("fb", own(n_stored)).withColumn("qb", other(n_asked))

    def run(q: pa.Table, f: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if q.num_rows and f.num_rows:
            order = np.argsort(f["id"].to_numpy(), kind="stable")
            found, ids = _matrix(f["v"], d)[order], f["id"].to_numpy()[order]
            for qid, near, dist in scan(_matrix(q["v"], d), q["id"].to_numpy(), found, ids, rotation, k):
                out.append((np.full(len(near), qid), near, dist))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ["list", "qb", "fb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score double")
    near = near.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

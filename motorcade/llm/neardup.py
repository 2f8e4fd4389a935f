"""Near-duplicates by MinHash bands with sequential Bayesian verification.

A document's set holds its distinct shingles of WIDTH words (ASCII lower case). Documents of equal sets form a class,
stood for by its smallest id. Classes that share a band of their MinHash signature are candidates. Signatures are
compared batch by batch; a pair goes as soon as the posterior probability that it reaches the threshold falls under
MISS. Survivors are verified on the full sets of their texts, and links joined to components.

Candidates are never all pairs of a bucket: each bucket first compares its members with one pivot, the member that
shares most buckets with others (an original rather than one of its copies), so a bucket of n alike members costs n.
Buckets that still hold members of different components go on. Those with few members left compare the pairs that are
still apart. The members of larger ones, which share a passage or an original without being alike, get an exact way:
their shingles are counted, and since sets that reach the threshold share one of their rarest shingles, at a place
that leaves enough to overlap, only such pairs of different components become candidates. Of a shingle's members those
of its main component aren't compared with each other, and a shingle of more than HOT members is split by set size: a
member at a late place of its order asks only the members whose sizes still allow the overlap. So no link between
components is lost. Rows are spread over tasks by joins that Spark can split, and labels spread by star contraction in
tables.

Equality of words, shingles and sets is that of 64-bit hashes (two for sets); links are confirmed on the full sets.

With 60 bands of 8 a pair at a similarity of 0.8 shares no band with probability 2e-5, one at 0.85 with 5e-9; MISS
adds at most 1e-6.

Edge cases: a text with fewer words than WIDTH is one shingle; null, empty or blank texts have no shingle and stand
alone; equal sets are one class; rows that repeat an id and its text get the same result; rows of one id with different
texts are grouped each by its own text, and where such an id stands for a class it is compared by the text of smallest
hash; a row without an id is in no component and kept; only the id and text columns are read; an empty table gives an empty result. Texts are handled in slices of whole documents of about 256 KB.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorcade.llm import kernels as K
from motorcade.llm.common import bounded, dropped, written

BANDS, ROWS = 60, 8
STEP = 40
MISS = 1e-6
#: A bucket with at most so many uncompared members compares those that are still apart.
SMALL = 32
#: A shingle with more members than this is split by set size, in steps of 1.1 %.
HOT = 64
SIZE_STEPS = 64

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    w = K.Words(data, off, True)
    first, h = w.windows(width)
    cut = np.searchsorted(first, w.first)
    out = []
    for d in range(len(off) - 1):
        n = w.count[d]
        if n >= width:
            out.append(np.unique(h[cut[d] : cut[d + 1]]))
        elif n:
            a = w.first[d]
            out.append(K.mix(K.chain([w.hash[a + j : a + j + 1] for j in range(n)]) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of sets that aren't empty, one row each."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out, t = np.empty((len(_MUL), len(sets)), np.uint32), np.empty_like(x)
    for k in range(len(_MUL)):
        np.bitwise_xor(x, _XOR[k], out=t)
        np.multiply(t, _MUL[k], out=t)
        out[k] = np.minimum.reduceat(t, starts)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    cols = []
    for b in range(BANDS):
        rows = [sig[:, b * ROWS + j].astype(np.uint64) for j in range(ROWS)]
        cols.append(K.mix(K.chain(rows) + np.uint64(b)))
    return np.stack(cols, 1).view(np.int64)


def signatures(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), fp1 and fp2 (128 bits of the set), sig (8 bits of each MinHash), bands, h (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.slices(b.column(1)):
                sets = shingle_sets(data, off, width)
                some = [i for i, s in enumerate(sets) if len(s)]
                sig, bands = [b""] * len(sets), [[]] * len(sets)
                if some:
                    s = minhash([sets[i] for i in some])
                    for i, row, key in zip(some, s.astype(np.uint8), band_keys(s), strict=True):
                        sig[i], bands[i] = row.tobytes(), key
                fp1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                fp2 = np.array([np.bitwise_xor.reduce(K.mix(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp1), pa.array(fp2), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), b.column(2).slice(lo, hi - lo)],
                    ["id", "n", "fp1", "fp2", "sig", "bands", "h"],
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded(df).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, "id long, n long, fp1 long, fp2 long, sig binary, bands array<long>, h long")


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each multiple of STEP hashes, the fewest matches at which the similarity still reaches the threshold with a
    posterior probability of `miss`, under a uniform prior: 1 - I_t(m + 1, n - m + 1), a binomial tail."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures doesn't rule out."""
    least = least_matches(threshold, miss)
    width = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in (2, 3))
            alive, same = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                same = same[: len(alive)] + (x[alive, part] == y[alive, part]).sum(1)
                ok = same >= m
                alive, same = alive[ok], same[ok]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive))], ["a", "b"])

    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose sets reach the threshold, from their whole texts (docs: id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def sets(ids: list[int], texts: pa.Array) -> dict[int, np.ndarray]:
            nonlocal held
            new = list({i: k for k, i in enumerate(ids) if i not in known}.items())
            some = texts.take(pa.array([k for _, k in new], pa.int64()))
            for lo, hi, data, off in K.slices(some):
                for (i, _), s in zip(new[lo:hi], shingle_sets(data, off, width), strict=True):
                    known[i] = s
                    held += len(s)
            return {i: known[i] for i in set(ids)}

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                left, right = sets(a_ids, b.column(2)), sets(b_ids, b.column(3))
                keep = []
                for k, (i, j) in enumerate(zip(a_ids, b_ids, strict=True)):
                    x, y = left[i], right[j]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(k)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])
                while held > 4_000_000:
                    held -= len(known.popitem(last=False)[1])

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shingles(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, shingle) of the texts of some ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.slices(b.column(1)):
                sets = shingle_sets(data, off, width)
                at = np.repeat(np.arange(lo, hi), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "shingle"])

    return docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, shingle long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id but the components' smallest, by large-star and small-star contraction."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or (mark["n"], mark["h"]) == before:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._motorcade_path = edges._motorcade_path
            return out
        before = (mark["n"], mark["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "small-star")
        dropped(edges, large)
        edges = new


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links) and kept (id = component_id)."""
    sigs = written(signatures(df, width, id_col, text_col), "signatures")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = sigs.where("n > 0 and id is not null").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    classes = written(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), F.col("rep"))
    shared = written(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(buckets.join(shared, "bucket"), "members")
    labels = None if members.isEmpty() else _linked(members, classes, sigs, docs, width, percent, miss)
    rep = classes.select("fp1", "fp2", "n", "rep")
    if labels is not None:
        rep = rep.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        rep = rep.withColumn("component", F.lit(None).cast("long"))
    out = sigs.select("id", "n", "fp1", "fp2").join(rep, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    dropped(shared, members)
    kind = dict(df.dtypes)[id_col]
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def _linked(members: DataFrame, classes: DataFrame, sigs: DataFrame, docs: DataFrame, width: int, percent: int, miss: float) -> DataFrame | None:
    """Component labels of class representatives that share a bucket (members: bucket, rep, size)."""

    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sets of other sizes can't reach it
    # how many rows of other members each representative meets over all its buckets
    met = members.groupBy("rep").agg(F.sum("size").alias("met")).join(classes.select("rep", "n"), "rep")
    met = written(met, "met")
    ids = met.select(F.col("rep").alias("id"))
    one = lambda t, c: t.join(ids, "id", "left_semi").groupBy("id").agg(F.min_by(c, "h").alias(c))
    sigs = written(one(sigs.where("n > 0").select("id", "sig", "h"), "sig"), "met-signatures")
    docs = written(one(docs.withColumn("h", F.xxhash64("text")), "text"), "met-texts")
    members = written(members.select("bucket", "rep").join(met, "rep"), "met-members")
    labels: DataFrame | None = None
    made: list[DataFrame] = []

    def take(pairs: DataFrame) -> None:
        """Verify candidates: first each member's partner of smallest id, then those that are still in other components."""
        nonlocal labels
        left = written(likely(pairs.distinct(), sigs, percent / 100, miss), "likely")
        for least in (True, False):
            part = left.groupBy("b").agg(F.min("a").alias("a")) if least else _apart(left, labels)
            new = written(verified(part, docs, width, percent), "links")
            if not new.isEmpty():
                stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b")) if labels is not None else None
                old, labels = labels, components(new if stars is None else new.unionByName(stars))
                if old is not None:
                    dropped(old)
            dropped(new)
        dropped(left)

    def prefix_pairs(rest: DataFrame) -> DataFrame:
        """Pairs of members of large buckets, of different components, that share one of their rarest shingles."""
        big = written(rest.where(F.col("left") > SMALL).select(F.col("rep").alias("id"), "n", "c").distinct(), "large")
        rows = written(shingles(big.select("id"), docs, width), "shingles")
        rows_k = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("k")), "shingle").join(big, "id")
        place = F.row_number().over(Window.partitionBy("id").orderBy("k", "shingle")) - 1
        needed = F.ceil(F.col("n") * percent / 100)
        prefix = rows_k.withColumn("place", place).where((F.col("place") <= F.col("n") - needed) & (F.col("k") > 1))
        prefix = written(prefix.select("shingle", "id", "n", "c", (F.col("n") - F.col("place")).alias("most")), "prefixes")
        parts = prefix.groupBy("shingle", "c").agg(F.count("*").alias("k"))
        main = parts.groupBy("shingle").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("held")).where("parts > 1")
        main = written(main.select("shingle", "main", (F.col("held") > HOT).alias("hot")), "main-components")
        x = prefix.join(main, "shingle").where("c != main").select("shingle", "hot", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("most").alias("ma"))
        y = prefix.select("shingle", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("most").alias("mb"))
        step = lambda n: F.floor(F.log2(n) * SIZE_STEPS).cast("int")
        # sizes that leave enough to overlap: most >= (na + nb) * percent / (100 + percent), and nb near na
        fewest = F.ceil(F.col("na") * percent / 100)
        largest = F.least(F.floor(F.col("ma") * (100 + percent) / percent) - F.col("na"), F.floor(F.col("na") * 100 / percent))
        asked = x.where("hot").where(largest >= fewest).withColumn("size", F.explode(F.sequence(step(fewest), step(largest))))
        most = F.least("ma", "mb")
        enough = (F.col("ca") != F.col("cb")) & (100 * most >= percent * (F.col("na") + F.col("nb") - most)) & near(F.col("na"), F.col("nb"))
        cold = x.where("not hot").join(y, "shingle").where(enough)
        hot = asked.join(y.join(main.where("hot"), "shingle", "left_semi").withColumn("size", step(F.col("nb"))), ["shingle", "size"]).where(enough)
        made.extend((big, rows, prefix, main))
        return cold.select("a", "b").unionByName(hot.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    best = F.struct("met", (-F.col("rep")).alias("neg"), F.col("n"))
    pivots = members.groupBy("bucket").agg(F.max(best).alias("p")).select("bucket", (-F.col("p.neg")).alias("p"), F.col("p.n").alias("pn"))
    pivots = written(pivots, "pivots")
    first = members.join(pivots, "bucket").where((F.col("rep") != F.col("p")) & near(F.col("n"), F.col("pn")))
    take(first.select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")))
    rest = members.join(pivots.select("bucket", F.col("p").alias("rep")), ["bucket", "rep"], "left_anti")
    for large in (True, False):
        now = rest.select("bucket", "rep", "n")
        now = now.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component") if labels is not None else now.withColumn("c", F.col("rep"))
        now = written(now, "uncompared")
        open_ = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("left")).where("lo != hi").select("bucket", "left")
        new = written(now.join(open_, "bucket"), "rest")
        dropped(now)
        if large:
            take(prefix_pairs(new))
            made.append(new)
            rest = new.where(F.col("left") <= SMALL)
            continue
        x = new.select("bucket", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
        y = new.select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
        take(x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near(F.col("na"), F.col("nb"))).select("a", "b"))
        dropped(new)
    dropped(met, sigs, docs, members, pivots, *made)
    return labels


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends have different labels so far."""
    if labels is None:
        return pairs
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

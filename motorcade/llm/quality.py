"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with language references by Jensen-Shannon
distance (base 2, so 0 to 1); the nearest language counts. References are sums over all rows of each language that
holds at least MIN_SHARE of all words, so there are at most 1 / MIN_SHARE of them, whatever the column holds.
A document shorter than a guard isn't judged by that histogram. Repetition and length rules reject first.

Edge cases: a null text has no words and fails the length rule; a null language adds to no reference but is judged
like any other; without any reference only the base rules hold. Only id, text and language columns are read.
Texts are handled in slices of whole documents of about 256 KB, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorcade.llm import kernels as K
from motorcade.llm.common import bounded, dropped, written

#: Fixed word lists: common words of each language.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not this are or at from an he which".split()
    + "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split()
    + "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split()
    + "de la que el en y a los se del las un por con no una su para es al lo como más o".split()
)
WORDS = tuple(dict.fromkeys(COMMON_WORDS))
CLASSES = ("lower", "upper", "digit", "space", "line", "mark", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
#: Guards: fewer characters or words than these aren't judged by the class or word histogram.
MIN_CHARS = 400
MIN_WORDS = 100
#: Share of all words that a language needs to be a reference.
MIN_SHARE = 0.001
#: Distances to the nearest language above which a document is rejected.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.33

_CLASS = np.full(256, 7, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = 5
_CLASS[list(SYMBOLS)] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_CLASS_N, _WORD_N = len(CLASSES), len(WORDS) + 1
_HASHES = K.hash_words(list(WORDS))
_ORDER = np.argsort(_HASHES)
_SORTED = _HASHES[_ORDER]


def histograms(data: np.ndarray, off: np.ndarray, low: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a slice: characters by class, and common words by word, the last column for all other words."""
    docs = len(off) - 1
    row = np.repeat(np.arange(docs), np.diff(off))
    chars = ~_CONT[data]
    classes = np.bincount((row * _CLASS_N + _CLASS[data])[chars], minlength=docs * _CLASS_N).reshape(docs, _CLASS_N)
    at = np.searchsorted(_SORTED, low.hash).clip(max=len(_SORTED) - 1)
    word = np.where(_SORTED[at] == low.hash, _ORDER[at], _WORD_N - 1)
    words = np.bincount(low.doc * _WORD_N + word, minlength=docs * _WORD_N).reshape(docs, _WORD_N)
    return classes, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from each row of counts q; 1 where either is empty."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)
    out = np.ones((len(p), len(q)))
    for j, r in enumerate(q):
        m = (p + r) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
            b = np.where(r > 0, r * np.log2(r / m), 0).sum(1)
        out[:, j] = np.where((p.sum(1) > 0) & (r.sum() > 0), np.sqrt(np.clip((a + b) / 2, 0, 1)), 1)
    return out


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a slice."""
    w = K.Words(data, off, False)
    docs = len(off) - 1
    out = {"n_words": w.count.astype(np.int64), "word_chars": K.per_doc(w.inside & ~_CONT[data], off), "n_symbols": K.per_doc(_SYMBOL[data], off)}
    # lines: cut at every \n and at the ends of documents
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(off[:-1], breaks + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = np.where((end > start) & (data[end - 1] == 10), end - 1, end) if len(start) else end
    doc = np.searchsorted(off, start, "right") - 1
    some = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[some], end[some], doc[some]
    key = K.chain([w.spans(start, end), doc.astype(np.uint64)])
    _, at = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=docs) - np.bincount(doc[at], minlength=docs)
    # words in windows of five that the document has twice or more
    first, h = w.windows(5)
    key = K.chain([h, w.doc[first].astype(np.uint64)])
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = first[times[back] > 1] if len(first) else first
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 5, -1)
    covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=docs)
    return out


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Histograms over all its rows of each language with MIN_SHARE of all words. A task sends one row per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            for lo, hi, data, off in K.slices(b.column(1)):
                classes, words = histograms(data, off, K.Words(data, off, True))
                both = np.hstack([classes, words])
                for x in set(lang[lo:hi]):
                    total[x] = total.get(x, 0) + both[lang[lo:hi] == x].sum(0)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "counts": [v.tolist() for v in total.values()]}, pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

    parts = bounded(df).where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, counts array<long>")
    sums = parts.select("lang", F.posexplode("counts")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    sums = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("h"))
    words = F.aggregate(F.slice("h", _CLASS_N + 1, _WORD_N), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = written(sums.withColumn("words", words), "references")
    total = rows.agg(F.sum("words")).first()[0] or 0
    found = rows.where(F.col("words") >= max(1.0, MIN_SHARE * total)).orderBy("lang").collect()
    dropped(rows)
    hist = {r["lang"]: [x["n"] for x in r["h"]] for r in found}
    return {k: (v[:_CLASS_N], v[_CLASS_N:]) for k, v in hist.items()}


def quality(df: DataFrame, refs: dict[str, tuple[list[int], list[int]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance (null where a guard holds or there is no reference)."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    class_ref = np.array([v[0] for v in refs.values()], float).reshape(-1, _CLASS_N)
    word_ref = np.array([v[1] for v in refs.values()], float).reshape(-1, _WORD_N)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.slices(b.column(1)):
                c = base_counts(data, off)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                classes, words = histograms(data, off, K.Words(data, off, True))
                a, bad_a = _nearest(classes, class_ref, classes.sum(1) >= MIN_CHARS, MAX_CLASS_DISTANCE)
                w, bad_w = _nearest(words, word_ref, c["n_words"] >= MIN_WORDS, MAX_WORD_DISTANCE)
                cols = [b.column(0).slice(lo, hi - lo), *[pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(failed), pa.array(~(failed | bad_a | bad_w)), pa.array(a, from_pandas=True), pa.array(w, from_pandas=True)],
                    [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
                )

    return bounded(df).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(judge, schema)


def _nearest(counts: np.ndarray, ref: np.ndarray, enough: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    d = js_distance(counts, ref).min(1) if len(ref) else np.full(len(counts), np.nan)
    d = np.where(enough, d, np.nan)
    return d, np.nan_to_num(d, nan=0.0) > most

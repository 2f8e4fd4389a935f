"""Language identification by a string kernel.

The blended-spectrum presence kernel of two pieces of text is the number of character n-grams (n = 1, 2, 3, hashed to
BITS bits) that both hold, over the root of the product of their own numbers. A text is the mean of its pieces of PIECE
characters, so long texts don't fill all bits. Nystroem landmarks, the same number from each language, give explicit
features; kernel ridge regression fits one score per language against the rest. Scores are linear in a text's features,
so landmarks and weights fold into one matrix, and a batch of pieces is scored by one product of its presence matrix
with it; a batch holds BATCH pieces, however long texts are and however many languages there are.

The fit reads at most MAX_FIT labelled rows (or FEWEST of each language, if there are more languages than that allows),
the same number of each language, those of smallest hash of the id, and whole texts; at most 2**BITS numbers for each
come to the driver. Of more than MAX_LANGS different labels, as a dirty column has, those of most rows are learnt.

Edge cases: a null text or one without a letter (Unicode category L) is `und` with score 0; without labels every text
is; rows without a language or text aren't learnt from; repeated rows are rated alike; only the id, text and language
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorcade.llm.common import bounded, dropped, written

BITS = 15
PIECE = 2048
BATCH = 128
MAX_FIT = 2048
FEWEST = 16
MAX_LANGS = 512
LANDMARKS = 256
RIDGE = 1e-2
SHARPNESS = 6.0
LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Sorted hashed n-grams that a text holds, in lower case."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    held = np.zeros(1 << BITS, bool)
    shift = np.uint32(32 - BITS)
    h = c * np.uint32(0x9E3779B1)
    held[h >> shift] = True
    for place in (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)):
        c = c[1:]
        h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + (c + np.uint32(1)) * place
        held[((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift] = True
    return np.flatnonzero(held)


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, float]]:
    """(text number, n-grams, weight) of all pieces; the weight is the piece's norm over the text's number of pieces."""
    for i, t in enumerate(texts):
        n = max(1, -(-len(t) // PIECE))
        for at in range(n):
            # the two characters behind a piece complete its last n-grams
            held = grams(t[at * PIECE : (at + 1) * PIECE + 2])
            yield i, held, 1 / (n * np.sqrt(max(1, len(held))))


def feature(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bits and values of a text's features, the mean over its pieces."""
    x = np.zeros(1 << BITS, np.float32)
    for _, held, weight in pieces([text]):
        x[held] += weight
    held = np.flatnonzero(x)
    return held, x[held]


def products(rows: Iterable[tuple[int, np.ndarray, np.ndarray | float]], n: int, matrix: np.ndarray) -> np.ndarray:
    """Sums by number of (number, bits, values) rows times a matrix with a row for each bit, in batches of dense rows."""
    out = np.zeros((n, matrix.shape[1]))
    batch = np.zeros((BATCH, 1 << BITS), np.float32)
    numbers: list[int] = []

    def flush() -> None:
        np.add.at(out, numbers, batch[: len(numbers)] @ matrix)
        batch[: len(numbers)] = 0
        numbers.clear()

    for i, held, values in rows:
        batch[len(numbers), held] = values
        numbers.append(i)
        if len(numbers) == BATCH:
            flush()
    flush()
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # 2**BITS x languages


def train(features: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LanguageModel:
    """Kernel ridge regression on Nystroem features, one score per language against the rest."""
    names = sorted(set(langs))
    kind = np.array(langs, object)
    each = max(1, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(kind == x)[:each] for x in names])
    land = np.zeros((1 << BITS, len(marks)), np.float32)
    for i, k in enumerate(marks):
        held, x = features[k]
        land[held, i] = x
    cross = products(((i, held, x) for i, (held, x) in enumerate(features)), len(features), land)
    values, vectors = np.linalg.eigh(cross[marks])
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = cross @ root
    target = np.where(kind[:, None] == np.array(names, object)[None, :], 1.0, -1.0)
    ridge = np.linalg.solve(phi.T @ phi + RIDGE * len(features) * np.eye(phi.shape[1]), phi.T @ target)
    return LanguageModel(names, (land @ (root @ ridge)).astype(np.float32))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_FIT, most_langs: int = MAX_LANGS) -> LanguageModel:
    """Learn from rows with a text and a language; the caller leaves out rows that must not be learnt from."""
    rows = bounded(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    held = rows.groupBy("lang").agg(F.count("*").alias("held"))
    held = written(held.orderBy(F.desc("held"), "lang").limit(most_langs), "languages")
    n = held.count()
    if not n:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    each = max(FEWEST, most // n)
    # a share of each language that holds some times as many rows as are picked, so that a frequent one's don't all meet
    share = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("held") <= 4.0 * each * (1 << 30)) | (F.col("held") <= 4 * each)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id"))
    some = rows.select("id", "lang").join(held, "lang").where(share).select("id", "lang").distinct()
    picked = written(some.withColumn("place", order).where(F.col("place") <= each).drop("place"), "lang-fit")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [feature(t) for t in b.column(2).to_pylist()]
            f, x = pa.array([f.astype(np.int32) for f, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), f, x], ["id", "lang", "f", "x"])

    some = rows.join(F.broadcast(picked), ["id", "lang"]).distinct()
    got = some.mapInArrow(featured, f"id {dict(docs.dtypes)[id_col]}, lang string, f array<int>, x array<float>").toArrow()
    dropped(picked, held)
    ids, langs = got["id"].to_pylist(), got["lang"].to_pylist()
    cols = [got[c].combine_chunks() for c in ("f", "x")]
    made = [tuple(c[i].values.to_numpy() for c in cols) for i in range(len(ids))]
    order = sorted(range(len(ids)), key=lambda i: (langs[i], str(ids[i]), made[i][1].tobytes()))
    return train([made[i] for i in order], [langs[i] for i in order])


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (soft maximum over languages, 0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model.langs and t and LETTER.search(t)]
            if known:
                s = products(pieces([texts[i] for i in known]), len(known), model.weights)
                e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                pred[known], score[known] = s.argmax(1), e.max(1) / e.sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return bounded(df).select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, lang_pred string, score double")

"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A classifier fitted on the labelled table predicts a document's domain posteriors: naive Bayes over binned text
measures (words, lines, capitals, digits, symbols, marks). A document's tokens (words) times its posteriors are its
expected tokens by domain. Projected-gradient least squares then fits one rate per document, at least `least`, whose
expected domain totals match the targets: x <- max(least, x - A'M(Ax - t)). The first M is H, the inverse of AA', which makes
one the right step size while no rate is bounded. As rates reach their bound that step gets too short, so M then comes from
the rows still free, F: the inverse of FF' + d AA', with a damping d that falls as long as steps bring totals nearer, in the
norm of H, and rises otherwise; a step that brings them no nearer isn't taken. Each step sends the driver one total per domain and one per pair
of domains; rates stay distributed, and a document's follows from its own posteriors and the steps. Steps go on until totals
meet the targets or plain steps hardly bring them nearer; what is missed then, which bounded rates or posteriors too alike can't mend, is a result.

Domains are the labelled table's classes, quality and toxicity together (q1t0 and so on).

Edge cases: a null or empty text has no tokens and its rate stays the one it starts from, 1 or `least`; documents without labels get
posteriors like any other; without labels there is one domain, `all`; a domain that expects no tokens can't be
weighted and is left out of the targets; repeated rows are repeated; only id and text (and the labels' three
columns) are read; columns to keep travel in one struct, so their names never clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorcade.llm.common import dropped, written

WORD = r"[^\x20\x09-\x0D]++"
#: Measures of a text, each a count that is binned by its logarithm relative to the words.
MEASURES = {"lines": r"\n", "capitals": r"[A-Z]{2,}+", "digits": r"[0-9]++", "symbols": r"[#*$%&|<>]++", "marks": r"[!?.,;:]"}
BINS = 16
SMOOTH = 1.0
#: Targets are the domains' own shares to this power, so that rare domains gain.
TEMPER = 0.8
#: Totals count as met within this share of the greatest target.
TOLERANCE = 1e-3
#: A step is good if it takes this share off the distance; where even a plain step takes less than the second share, totals stand still.
GOOD, STILL = 1e-2, 1e-3
#: Bounds of the damping: at 1 a step is plain.
DAMPING = 1e-3, 1.0
#: Steps held in one plan before rates are written out.
CHAIN = 8


def measured(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept (the `keep` columns, if any), n_tokens and bins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.col(id_col).alias("id"), *([F.struct(*keep).alias("kept")] if keep else []), text.alias("text"))
    df = df.withColumn("n_tokens", F.regexp_count("text", F.lit(WORD)).cast("long"))
    words = F.greatest(F.col("n_tokens"), F.lit(1))
    bins = [F.least(F.lit(BINS - 1), F.floor(F.log2(F.col("n_tokens") + 1)))]
    bins += [F.least(F.lit(BINS - 1), F.floor(F.log2(1 + 1000 * F.regexp_count("text", F.lit(rx)) / words))) for rx in MEASURES.values()]
    return df.withColumn("bins", F.array(*[b.cast("int") for b in bins])).drop("text")


def domains(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict[str, tuple[float, list[list[float]]]]:
    """Log prior and log likelihoods by measure and bin of each domain; at most classes times measures times bins rows come to the driver."""
    ok = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    named = ok.select(F.col(id_col).alias("id"), name.alias("domain")).distinct()
    counts = rows.select("id", "bins").join(named, "id").select("domain", F.posexplode("bins").alias("m", "bin"))
    got = counts.groupBy("domain", "m", "bin").agg(F.count("*").alias("n")).collect()
    n = {}
    for r in got:
        n.setdefault(r["domain"], np.full((len(MEASURES) + 1, BINS), SMOOTH))[r["m"], r["bin"]] += r["n"]
    if not n:
        return {"all": (0.0, np.zeros((len(MEASURES) + 1, BINS)).tolist())}
    total = sum(v[0].sum() for v in n.values())
    return {k: (math.log(v[0].sum() / total), np.log(v / v.sum(1, keepdims=True)).tolist()) for k, v in sorted(n.items())}


def posteriors(model: dict) -> Column:
    """Array of domain posteriors of a row with `bins`."""
    scores = []
    for prior, tables in model.values():
        s = F.lit(prior)
        for m, row in enumerate(tables):
            s = s + F.get(F.array(*[F.lit(x) for x in row]), F.get("bins", F.lit(m)))
        scores.append(s)
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = F.array(*[F.exp(s - top) for s in scores])
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0, grow: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, kept (a struct of the `keep` columns, if any), n_tokens, posteriors (by domain name), rate, and missed, the
    greatest distance of a domain's total from its target as a share of the greatest target.

    targets: a weight for each domain; by default its share to the power TEMPER. The targets' sum is the corpus's own
    tokens or, with `grow`, the least that shrinks no domain."""
    rows = written(measured(docs, id_col, text_col, keep), "measured")
    model = domains(rows, labels)
    names = list(model)
    start = max(1.0, float(least))
    # documents of equal measures have equal rates, so rates are fitted on the different measures and their counts
    table = rows.groupBy("n_tokens", "bins").agg(F.count("*").alias("times")).withColumn("p", posteriors(model)).drop("bins")
    table = written(table.withColumn("rate", F.lit(start)), "posteriors")
    expected = [F.col("n_tokens") * F.get("p", F.lit(i)) for i in range(len(names))]
    times = F.col("times")
    k = range(len(names))
    first = table.agg(*[F.sum(times * x).alias(f"s{i}") for i, x in enumerate(expected)], *[F.sum(times * expected[i] * expected[j]).alias(f"g{i}_{j}") for i in k for j in k if i <= j]).first()
    own = np.array([first[f"s{i}"] or 0.0 for i in k])
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k])


    def named(steps: list[np.ndarray], missed: float) -> DataFrame:
        by_name = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.col("p"))
        rate = F.lit(start)
        if steps:
            moves = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in steps])
            dot = lambda m: F.aggregate(F.zip_with("p", m, lambda x, v: x * v), F.lit(0.0), lambda a, x: a + x)
            rate = F.aggregate(moves, rate, lambda r, m: F.greatest(F.lit(float(least)), r - F.col("n_tokens") * dot(m)))
        out = rows.withColumn("p", posteriors(model))
        return out.select(F.col("id").alias(id_col), *(["kept"] if keep else []), "n_tokens", by_name.alias("posteriors"), rate.alias("rate"), F.lit(missed).alias("missed"))

    if own.sum() <= 0:
        dropped(table)
        return named([], 0.0)
    weight = np.array([targets.get(x, 0.0) for x in names]) if targets else (own / own.sum()) ** TEMPER
    weight = np.where(own > 0, weight, 0)
    weight /= weight.sum()
    scale = max(o / w for o, w in zip(own, weight, strict=True) if w > 0) if grow else own.sum()
    goal = weight * scale
    rate, moves, tried = F.col("rate"), 0, None

    def totals(push: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals after one step more, and the products of the rows that it leaves free."""
        nonlocal tried
        change = sum((x * F.lit(float(v)) for x, v in zip(expected, push, strict=True)), F.lit(0.0))
        tried = F.greatest(F.lit(float(least)), rate - change)
        moved = table.select("n_tokens", "p", "times", tried.alias("rate"))
        above = F.when(F.col("rate") > float(least), times).otherwise(0)
        got = moved.agg(*[F.sum(times * x * F.col("rate")).alias(f"s{i}") for i, x in enumerate(expected)], *[F.sum(above * expected[i] * expected[j]).alias(f"g{i}_{j}") for i in k for j in k if i <= j]).first()
        return np.array([got[f"s{i}"] or 0.0 for i in k]), np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k])

    def take() -> None:
        nonlocal table, rate, moves
        rate, moves = tried, moves + 1
        if moves % CHAIN == 0:
            new = written(table.withColumn("rate", rate), "rates")
            dropped(table)
            table, rate = new, F.col("rate")

    steps, now = stepped(own * start, goal, gram, gram if start > least else 0 * gram, totals, take)
    dropped(table)
    return named(steps, float(np.abs(now - goal).max() / goal.max()))


def stepped(now: np.ndarray, goal: np.ndarray, gram: np.ndarray, free: np.ndarray, totals, take) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps from the totals `now` towards `goal`, and the totals they lead to. totals(push) tries a step, take() keeps it;
    gram and free are the products AA' of all rows and of those above their bound."""
    gram = gram + 1e-9 * np.trace(gram) * np.eye(len(goal))
    metric, steps, damp = np.linalg.inv(gram), [], DAMPING[1]
    far = lambda t: math.sqrt(max(0.0, (t - goal) @ metric @ (t - goal)))
    while np.abs(now - goal).max() > TOLERANCE * goal.max():
        push = (metric if damp >= DAMPING[1] else np.linalg.inv(free + damp * gram)) @ (now - goal)
        then, left = totals(push)
        gain = 1 - far(then) / far(now)
        if gain > 0:
            take()
            steps.append(push)
            now, free = then, left
        if gain > GOOD:
            damp = max(DAMPING[0], damp / 4)
        elif damp < DAMPING[1]:
            damp = min(DAMPING[1], damp * 8)
        elif not gain >= STILL:
            break
        else:
            damp /= 4
    return steps, now


def copies(id_col: str = "doc_id") -> Column:
    """Whole copies for a rate: its floor, and one more with the probability of the rest, drawn by the id's hash."""
    u = F.pmod(F.xxhash64(F.lit("mix"), id_col), F.lit(1 << 20)) / (1 << 20)
    return (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")

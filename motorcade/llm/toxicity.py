"""Toxicity by a weighted finite-state pattern grammar.

Words become terminals: insult, threat, target, negation, report, other. Four small transducers (a negation near, a
target near, speech reported, a threat that waits for its target) are composed into one table of states. Running it
over a clause yields paths: a word of an insult or threat with its pattern, which says whether a target, a negation and
reported speech go with it. A threat weighs what its pattern does, in log-odds. An insult weighs that of its stem's arc
plus that of its whole word's, so a harmless word of a harmful stem cancels out, times its pattern's factor. A
document's score is the logistic function of the sum over the different paths of its clauses. Clauses without an
insult or threat yield nothing; a string automaton skips them.

Insults come from a fixed list and from labelled rows: all stems, and words of as many letters as the shortest stem,
that toxic rows use three times as often as others and behind different words in a hundredth of toxic rows. Their
weights come from a ridge logistic regression on the paths of labelled rows: arcs and threat patterns given the
patterns' factors, and these given the arcs, in turns; what labels say nothing of stays near the fixed weights. Labels
come from at most MAX_FIT labelled rows, those of smallest hash of the id. Texts are read whole.

Edge cases: a null or empty text has the score of a text without matches; no labels leave the fixed list; labels other
than 0 and 1 are none, and of a row's contradicting ones 1 holds; repeated texts of one label count once in the fit; only id and text (and the labels' id and label) are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorcade.llm.common import bounded, dropped, written

#: Bound on labelled rows read for the fit.
MAX_FIT = 12_000
REJECT_AT = 0.7
#: Fixed word lists.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile bastard".split()
THREATS = "kill murder destroy hurt beat".split()
TARGETS = "you your he she they them him her du dich dein ihr tu te vous toi usted ustedes eres".split()
NEGATIONS = "not no never nor isn't aren't wasn't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says called claimed quoted wrote reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
#: Log-odds of a listed insult, and of a threat with and without a target near.
LISTED = 5.0
THREAT_WEIGHTS = (3.0, 0.3)
TARGET_GAIN = 1.1
NEGATED = REPORTED = 0.8
REACH = 4
STEMS = (4, 5, 6, 7, 8)
RIDGE = 0.3
#: Turns of the fit.
TURNS = 2
#: Counts that a task holds before it sends them on.
HELD = 100_000

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n]")
_CLASS = {w: c for c, ws in (("neg", NEGATIONS), ("rep", REPORTS), ("tgt", TARGETS), ("thr", THREATS)) for w in ws}
TERMINALS = ("oth", "ins", "thr", "tgt", "neg", "rep")
#: Bits of a pattern, and the mark that the last threat of the clause has met its target.
TARGET, NEGATION, REPORT, MET = 1, 2, 4, 8
PATTERNS = range(8)


@dataclass(frozen=True)
class Transducer:
    """A start state and a step (state, terminal) -> (state, mark)."""

    start: int
    step: Callable[[int, str], tuple[int, int]]


def _near(terminal: str, mark: int) -> Transducer:
    """Marks words fewer than REACH behind a terminal."""

    def step(s: int, x: str) -> tuple[int, int]:
        s = 0 if x == terminal else min(s + 1, REACH)
        return s, mark if s < REACH else 0

    return Transducer(REACH, step)


def _since(terminal: str, mark: int) -> Transducer:
    """Marks all words from a terminal to the end of the clause."""

    def step(s: int, x: str) -> tuple[int, int]:
        s = 1 if x == terminal else s
        return s, mark if s else 0

    return Transducer(0, step)


def _meeting(first: str, second: str, mark: int) -> Transducer:
    """Marks a second terminal fewer than REACH behind a first one that still waits for it."""

    def step(s: int, x: str) -> tuple[int, int]:
        if x == second:
            return REACH, mark if s + 1 < REACH else 0
        return 0 if x == first else min(s + 1, REACH), 0

    return Transducer(REACH, step)


def composed(parts: list[Transducer]) -> list[list[tuple[int, int]]]:
    """The product of transducers over its reachable states: table[state][terminal] is (next state, all marks); 0 is the start."""
    start = tuple(t.start for t in parts)
    number, todo, table = {start: 0}, [start], []
    for state in todo:
        row = []
        for x in TERMINALS:
            steps = [t.step(s, x) for t, s in zip(parts, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], sum(m for _, m in steps)))
        table.append(row)
    return table


TABLE = composed([_near("neg", NEGATION), _near("tgt", TARGET), _since("rep", REPORT), _meeting("thr", "tgt", MET)])
_NUMBER = {x: i for i, x in enumerate(TERMINALS)}


def _factor(pattern: int) -> float:
    """What a pattern's negation and report leave of a weight before labels are seen."""
    return (NEGATED if pattern & NEGATION else 1.0) * (REPORTED if pattern & REPORT else 1.0)


def _gains() -> list[float]:
    return [(TARGET_GAIN if p & TARGET else 1.0) * _factor(p) for p in PATTERNS]


def _threats() -> list[float]:
    return [THREAT_WEIGHTS[0 if p & TARGET else 1] * _factor(p) for p in PATTERNS]


@dataclass
class Grammar:
    """Weights of whole words' and stems' arcs, factors of insults' patterns, weights of threats' patterns, and the
    log-odds of a text without a match."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, LISTED))
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    gains: list[float] = field(default_factory=_gains)
    threats: list[float] = field(default_factory=_threats)

    def compiled(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            a.add_word(w, w)
        a.make_automaton()
        return a

    def arcs(self, word: str) -> list[str]:
        """Stems of a word that have an arc."""
        return [word[:n] for n in STEMS if word[:n] in self.stems and len(word) >= n]

    def paths(self, text: str) -> list[tuple[str, bool, int]]:
        """(word, whether it is a threat, pattern) of the paths that the table yields over a clause."""
        state, out, last = 0, [], None
        for w in WORD.findall(text):
            kind = _CLASS.get(w) or ("ins" if w in self.words or self.arcs(w) else "oth")
            state, marks = TABLE[state][_NUMBER[kind]]
            if marks & MET:
                word, threat, pattern = out[last]
                out[last] = (word, threat, pattern | TARGET)
            if kind in ("ins", "thr"):
                out.append((w, kind == "thr", marks & ~MET))
                last = len(out) - 1 if kind == "thr" else last
        return out

    def clause(self, text: str) -> list[list]:
        """[word, gain, negated, reported] of the paths in a clause, in readable form; a threat's word has + or - behind."""
        return [
            [w + ("+" if p & TARGET else "-") if threat else w, 1.0 if threat or not p & TARGET else TARGET_GAIN, bool(p & NEGATION), bool(p & REPORT)]
            for w, threat, p in self.paths(text)
        ]

    def clauses(self, automaton, text: str) -> list[list[tuple[str, bool, int]]]:
        """Paths of every clause that holds an insult or threat."""
        low = text.lower()
        out, done = [], 0
        for end, w in automaton.iter(low):
            at = end - len(w) + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            if w not in self.stems and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            left = max(low.rfind(c, done, at) for c in ".!?;\n") + 1
            left = max(left, done)
            stop = CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            if got := self.paths(low[left:done]):
                out.append(got)
        return out

    def evidence(self, automaton, text: str) -> Counter:
        """Number of different paths of a text by arc and pattern; a word's arc has $ behind, the arc of threats is empty."""
        out = Counter()
        for w, threat, p in {path for clause in self.clauses(automaton, text) for path in clause}:
            for arc in [""] if threat else [*([w + "$"] if w in self.words else []), *self.arcs(w)]:
                out[arc, p] += 1
        return out

    def weight(self, arc: str, pattern: int) -> float:
        if not arc:
            return self.threats[pattern]
        return (self.words[arc[:-1]] if arc.endswith("$") else self.stems[arc]) * self.gains[pattern]

    def score(self, automaton, text: str) -> float:
        total = self.bias + sum(n * self.weight(*key) for key, n in sorted(self.evidence(automaton, text).items()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _stems(text: str) -> dict[str, str]:
    """Whole words (with $ behind) and stems of a text, with the word before one occurrence."""
    out, before = {}, ""
    for w in WORD.findall(text.lower()):
        if len(w) >= STEMS[0]:
            out.setdefault(w + "$", before)
        for n in STEMS:
            if len(w) >= n:
                out.setdefault(w[:n], before)
        before = w
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_FIT) -> Grammar:
    """Learn a grammar from labelled rows; the caller leaves out rows that must not be learnt from."""
    label = F.col(label_col).cast("int")
    picked = labels.where(label.isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("y"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = bounded(docs).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    rows = written(rows.select("y", "text").distinct(), "toxic-fit")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        dropped(rows)
        return Grammar()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("f", pa.string()), ("p", pa.string()), ("n", pa.int64())])
        pairs: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                pairs.update(_stems(t).items())
                if len(pairs) >= HELD:
                    yield pa.RecordBatch.from_pydict({"f": [f for f, _ in pairs], "p": [p for _, p in pairs], "n": list(pairs.values())}, schema)
                    pairs.clear()
        yield pa.RecordBatch.from_pydict({"f": [f for f, _ in pairs], "p": [p for _, p in pairs], "n": list(pairs.values())}, schema)

    least = max(3, bad // 100)
    found = rows.where("y = 1").select("text").mapInArrow(contexts, "f string, p string, n long")
    found = found.groupBy("f", "p").agg(F.sum("n").alias("n")).groupBy("f").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
    seen = {r["f"]: r["n"] for r in found.where(F.col("contexts") >= least).collect()}

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(seen.keys() & _stems(t).keys())
        yield pa.RecordBatch.from_pydict({"f": list(n), "n": list(n.values())}, pa.schema([("f", pa.string()), ("n", pa.int64())]))

    counts = rows.where("y = 0").select("text").mapInArrow(clean, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    other = {r["f"]: r["n"] for r in counts.collect()}
    more = {f for f, n in seen.items() if n / bad > 3 * (other.get(f, 0) + 0.5) / good}
    stems = set()
    for f in sorted((f for f in more if not f.endswith("$")), key=lambda f: (-len(f), f)):
        forms = max((seen[x] for x in more if x.endswith("$") and x.startswith(f)), default=0)
        longer = max((seen[x] for x in stems if x.startswith(f)), default=0)
        if seen[f] > 1.05 * max(forms, longer):  # else a whole word or a longer stem says the same
            stems.add(f)
    arcs = sorted(stems) + sorted(f for f in seen if f.endswith("$") and (f in more or any(f.startswith(x) for x in stems)))
    learnt = len(arcs)
    arcs += [w + "$" for w in INSULTS if w + "$" not in set(arcs)]
    g = Grammar(words={f[:-1]: 0.0 for f in arcs if f.endswith("$")}, stems={f: 0.0 for f in arcs if not f.endswith("$")})
    at = {"": -1} | {f: i for i, f in enumerate(arcs)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = g.compiled()
        for b in batches:
            out = [sorted([at[f], p, n] for (f, p), n in g.evidence(a, t).items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["y", "x"])

    got = rows.select(F.col("y").cast("int"), "text").mapInArrow(features, "y int, x array<array<int>>")
    got = got.groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    prior = np.array([(LISTED / 2 if i < learnt else LISTED) if f.endswith("$") and f[:-1] in INSULTS else 0.0 for i, f in enumerate(arcs)])
    weights = fit_paths([r["x"] for r in got], np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float), prior)
    arc_weights, g.gains, g.threats, g.bias = weights
    for f, v in zip(arcs, arc_weights, strict=True):
        if f.endswith("$"):
            g.words[f[:-1]] = v
        else:
            g.stems[f] = v
    dropped(rows)
    return g


def fit_paths(rows: list, y: np.ndarray, n: np.ndarray, prior: np.ndarray) -> tuple[list[float], list[float], list[float], float]:
    """Weights of arcs, factors of patterns, weights of threat patterns and the bias from rows of (arc or -1 for a threat,
    pattern, count). The factor of the plain pattern is 1."""
    flat = np.array([(i, *path) for i, r in enumerate(rows) for path in r], int).reshape(-1, 4)
    threat = flat[:, 1] < 0
    row, arc, pattern, count = flat[~threat].T
    m, k = len(prior), len(PATTERNS)
    x = np.zeros((len(rows), m + k + 1))
    x[:, -1] = 1
    np.add.at(x, (flat[threat, 0], m + flat[threat, 2]), flat[threat, 3])
    base, gains = np.array([*prior, *_threats(), 0.0]), np.array(_gains())
    for turn in range(TURNS + 1):
        x[:, :m] = 0
        np.add.at(x, (row, arc), count * gains[pattern])
        w = ridge_logistic(x, y, n, base)
        if turn < TURNS:
            z = np.zeros((len(rows), k))
            np.add.at(z, (row, pattern), count * w[arc])
            fixed = z[:, 0] + x[:, m:-1] @ w[m:-1]
            z = np.hstack([z[:, 1:], np.ones((len(rows), 1))])
            gains[1:] = ridge_logistic(z, y, n, np.array([*_gains()[1:], w[-1]]), fixed=fixed)[:-1]
    return w[:m].tolist(), gains.tolist(), w[m:-1].tolist(), float(w[-1])


def ridge_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, steps: int = 25, fixed: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, drawn towards `prior`; the last column, the bias, is not.
    `fixed` are log-odds that rows have besides."""
    w = prior.copy()
    shrink = np.full(len(w), RIDGE)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        grad = x.T @ (n * (p - y)) + shrink * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, kept (a struct of the `keep` columns, if any) and score, 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = grammar.compiled()
        for b in batches:
            text = pc.struct_field(b.column(1), text_col) if text_col in keep else b.column(1)
            scores = [grammar.score(a, t.as_py() or "") for t in text]
            yield pa.RecordBatch.from_arrays([b.column(0), *([b.column("kept")] if keep else []), pa.array(scores, pa.float64())], names)

    names = [id_col, *(["kept"] if keep else []), "score"]
    sent = bounded(df).select(F.col(id_col).alias("id"), *([] if text_col in keep else [F.col(text_col).alias("text")]), *([F.struct(*keep).alias("kept")] if keep else []))
    kinds = dict(sent.dtypes)
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [kinds["id"], *([kinds["kept"]] if keep else []), "double"], strict=True))
    return sent.mapInArrow(run, schema)

"""Token counts by prefix dynamic programming over a subword model with byte fallback.

In a merge model the encoding of a prefix has one last piece, and a pair of neighbours is possible in an encoding
only if encoding their joined text gives the pair back. So the last piece of each prefix follows from those of
shorter prefixes: try the pieces that end there, longest first, and take the one that fits the piece before it.
count[i] = count[i - len(piece)] + 1 then holds for every prefix, without encoding any prefix.

Texts are cut into units, each a run of spaces with the word after it: no piece of the vocabulary goes on after a
letter with a space, so counts add up over units. Units and the states of common beginnings are kept.

Edge cases: a null or empty text has 0 tokens and prefix 0 only; characters outside the vocabulary count one token
per UTF-8 byte; control strings in a text are ordinary text; only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorcade.llm.common import bounded

LIMIT = 4096
SPACE = "▁"
UNIT = re.compile(rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
#: Units kept in memory, and the longest that is kept.
CACHE = 1_000_000
LONGEST = 48
#: States after this many characters of a unit are kept, for units that begin alike.
HEAD = 6


class PrefixCounter:
    """Exact token counts of prefixes for one sentencepiece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp = self.sp
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.most = max(map(len, self.pieces), default=1)
        if any(re.search(rf"[^{SPACE}]{SPACE}|\n", p) and len(p) > 1 for p in self.pieces):
            raise ValueError("pieces cross units")
        self.pair: dict[tuple[str, str], bool] = {}
        self.unit: dict[str, int] = {}
        self.head: dict[str, tuple[list[int], list[str]]] = {}
        ends: dict[str, set[int]] = {}
        for p in self.pieces:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        two = {p for p in self.pieces if len(p) == 2}
        #: Lengths over one of the pieces that end with these three characters (or two, at a unit's start), longest first.
        self.ends = {p: (2,) for p in two}
        self.two = two
        for e, n in ends.items():
            self.ends[e] = tuple(sorted(n | ({2} if e[-2:] in two else set()), reverse=True))

    def merge(self, text: str) -> list[str]:
        """Encoding of a short text: join the neighbours of the best score, leftmost first, while any join is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.pieces[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.pieces), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        ok = self.pair.get((a, b))
        if ok is None:
            if len(self.pair) > 2 * CACHE:
                self.pair.clear()
            ok = self.pair[a, b] = self.merge(a + b) == [a, b]
        return ok

    def _cost(self, piece: str) -> int:
        return 1 if len(piece) > 1 or piece in self.pieces else len(piece.encode())

    def prefixes(self, unit: str) -> tuple[list[int], list[str]]:
        """Tokens and last piece of every prefix of a unit, the empty one first."""
        head = self.head.get(unit[:HEAD])
        counts, last = (head[0].copy(), head[1].copy()) if head else ([0], [""])
        ends, pairs, pieces = self.ends, self.pair, self.pieces
        for i in range(len(counts), len(unit) + 1):
            for n in (ends.get(unit[i - 3 : i]) or ends.get(unit[i - 2 : i], ()) if i > 2 else ends.get(unit[:i], ())):
                j = i - n
                if j < 0:
                    continue
                p = unit[j:i]
                if p in pieces:
                    ok = not j or pairs.get((last[j], p))
                    if ok or ok is None and self.fits(last[j], p):
                        break
            else:
                n, p = 1, unit[i - 1]
                if i > 1 and not self.fits(last[i - 1], p):  # no single last piece fits: encode this prefix itself
                    parts = self.merge(unit[:i])
                    counts.append(sum(map(self._cost, parts)))
                    last.append(parts[-1])
                    continue
            counts.append(counts[i - n] + (1 if n > 1 or p in pieces else len(p.encode())))
            last.append(p)
            if i == HEAD and not head:
                if len(self.head) > CACHE:
                    self.head.clear()
                self.head[unit[:HEAD]] = (counts.copy(), last.copy())
        return counts, last

    def of_unit(self, unit: str) -> int:
        got = self.unit.get(unit)
        if got is None:
            got = self.prefixes(unit)[0][-1]
            if len(unit) <= LONGEST:
                if len(self.unit) >= CACHE:
                    self.unit.clear()
                self.unit[unit] = got
        return got

    @staticmethod
    def escaped(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def count(self, text: str) -> int:
        known, of = self.unit.get, self.of_unit
        total = 0
        for u in UNIT.findall(self.escaped(text)):
            n = known(u)
            total += of(u) if n is None else n
        return total

    def table(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)


class PrefixTable:
    """Counts at all prefixes of one text: totals at unit ends, and the unit's own counts in between."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, counter.escaped(text)
        self.ends, self.totals = [0], [0]
        for m in UNIT.finditer(self.text):
            self.ends.append(m.end())
            self.totals.append(self.totals[-1] + counter.of_unit(m.group()))

    def __getitem__(self, chars: int) -> int:
        """Tokens of the text's first `chars` characters."""
        if chars <= 0 or not self.text:
            return 0
        at = min(chars + 1, len(self.text))
        k = bisect_right(self.ends, at) - 1
        if self.ends[k] == at:
            return self.totals[k]
        return self.totals[k] + self.counter.prefixes(self.text[self.ends[k] : self.ends[k + 1]])[0][at - self.ends[k]]

    def fit(self, budget: int) -> int:
        """Most characters whose tokens number at most `budget`; counts of prefixes needn't rise steadily, so the unit that passes the budget is searched from its end."""
        k = max((i for i in range(max(0, bisect_right(self.totals, budget) - 1), len(self.totals)) if self.totals[i] <= budget), default=0)
        best = self.ends[k]
        if k + 1 < len(self.ends):
            inner, _ = self.counter.prefixes(self.text[self.ends[k] : self.ends[k + 1]])
            best += max(i for i, n in enumerate(inner) if self.totals[k] + n <= budget)
        return max(0, best - 1)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    """One counter per process and model."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PrefixCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(df: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and, if asked for, fit_chars (characters that fit the limit) with
    unit_ends and unit_totals, the stored prefix counts at unit ends."""
    more = ", fit_chars long, unit_ends array<int>, unit_totals array<int>" if prefixes else ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            tables = [c.table(t) for t in texts] if prefixes else []
            n = [t.totals[-1] for t in tables] if prefixes else [c.count(t) for t in texts]
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                cols += [pa.array([t.fit(limit) for t in tables], pa.int64()), pa.array([t.ends for t in tables], pa.list_(pa.int32())), pa.array([t.totals for t in tables], pa.list_(pa.int32()))]
                names += ["fit_chars", "unit_ends", "unit_totals"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return bounded(df).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean{more}")

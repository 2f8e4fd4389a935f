"""Rules that depend on what an earlier row decided, run for many keys at once.

Rows are dealt by key and sorted by time within partitions; keys mix. Of each batch, the first rows of all keys take a
step together, as arrays, then their second rows, and so on. So a step costs a few array operations however many keys
take part, and memory holds one state per key of the task and a batch. A batch in which one key has all rows takes a
step per row, as any sequential rule does. Streaming queries run the same machines with the state of one key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Arrays = dict[str, np.ndarray]
#: Rows that take their steps together at most.
ROWS = 1 << 16


class Machine(Protocol):
    #: Columns that a step reads, as numbers; nulls are NaN.
    columns: tuple[str, ...]
    #: State of a key that has had no row.
    start: dict[str, float | int | bool]
    #: What a step yields besides `when`, the rows for which it yields anything.
    schema: str

    def step(self, state: Arrays, row: Arrays) -> tuple[Arrays, Arrays]: ...


class Lanes:
    """A machine and the states of the keys met so far."""

    def __init__(self, machine: Machine, state: Arrays | None = None):
        self.machine, self.slots = machine, {}
        self.state = state or {k: np.array([v] * 0, np.array(v).dtype) for k, v in machine.start.items()}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        code, distinct = pd.factorize(keys)
        for k in distinct:
            self.slots.setdefault(k, len(self.slots))
        more = len(self.slots) - len(next(iter(self.state.values())))
        if more > 0:
            self.state = {k: np.concatenate([v, np.full(more, self.machine.start[k], v.dtype)]) for k, v in self.state.items()}
        return np.array([self.slots[k] for k in distinct], np.int64)[code]

    def advance(self, keys: np.ndarray, rows: Arrays) -> tuple[np.ndarray, Arrays]:
        """Numbers of the rows that yield something, and what they yield, for rows in time order."""
        slot = self._slots(keys)
        by_key = np.argsort(slot, kind="stable")
        first = np.flatnonzero(np.diff(slot[by_key], prepend=-1))
        place = np.empty(len(slot), np.int64)
        place[by_key] = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        turn = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place)) if len(place) else []
        at, made, begin = [], [], 0
        for end in ends:
            now = turn[begin:end]
            begin, own = end, slot[now]
            new, out = self.machine.step({k: v[own] for k, v in self.state.items()}, {k: v[now] for k, v in rows.items()})
            for k, v in new.items():
                self.state[k][own] = v
            when = out.pop("when")
            if when.any():
                at.append(now[when])
                made.append({k: v[when] for k, v in out.items()})
        if not at:
            return np.zeros(0, np.int64), {}
        return np.concatenate(at), {k: np.concatenate([m[k] for m in made]) for k in made[0]}


def numbers(column: pa.Array) -> np.ndarray:
    """A column as numbers, nulls as NaN; whole numbers without nulls stay whole."""
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    if column.null_count:
        column = column.cast(pa.float64())
    return column.to_numpy(zero_copy_only=False)


def run(df: DataFrame, key: str, order: list[str | Column], machine: Machine, keep: list[str]) -> DataFrame:
    """The `keep` columns of the rows that yield something, with what they yield. Rows with a null key are left out."""
    kept = StructType([df.schema[c] for c in keep])
    schema = StructType([*kept.fields, *(StructType.fromDDL(machine.schema).fields if machine.schema else [])])
    arrow = to_arrow_schema(schema)
    sent = list(dict.fromkeys([key, *keep, *machine.columns]))

    def step(lanes: Lanes, table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        col = {c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in sent}
        at, made = lanes.advance(col[key].to_numpy(zero_copy_only=False), {c: numbers(col[c]) for c in machine.columns})
        taken = pa.array(at)
        out = [col[f.name].take(taken) for f in kept]
        out += [pa.array(made[f.name], f.type) if made else pa.array([], f.type) for f in list(arrow)[len(keep) :]]
        return pa.RecordBatch.from_arrays(out, schema=arrow)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, held, n = Lanes(machine), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield step(lanes, pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield step(lanes, pa.Table.from_batches(held))

    return df.where(df[key].isNotNull()).repartition(key).sortWithinPartitions(*order).select(*sent).mapInArrow(go, schema)


class Cooldown:
    """Yields a row when the last one yielded is at least (or, if strict, more than) so many milliseconds back."""

    columns, schema = ("ts_ms",), ""
    start = {"last": -(1 << 60)}

    def __init__(self, cooldown_ms: int, strict: bool):
        self.least = cooldown_ms + strict

    def step(self, state: Arrays, row: Arrays) -> tuple[Arrays, Arrays]:
        far = row["ts_ms"] - state["last"] >= self.least
        return {"last": np.where(far, row["ts_ms"], state["last"])}, {"when": far}

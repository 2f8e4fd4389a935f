"""Stateful processors over the machines and buffers that batch queries use."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from motorcade.config import REORDER
from motorcade.operators.lockstep import Lanes, Machine
from motorcade.operators.order import Mark, released
from motorcade.operators.trips import TripMachine


class Stored(StatefulProcessor):
    """One pickled state value per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value binary")

    def load(self):
        return pickle.loads(self.state.get()[0]) if self.state.exists() else None

    def store(self, value) -> None:
        self.state.update((pickle.dumps(value),))

    def close(self) -> None:
        pass


class Stepped(Stored):
    """A machine whose state of the key is stored between batches; yields its `keep` columns and what it makes."""

    machine: Machine
    keep: list[str]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        lanes = Lanes(self.machine, self.load())
        if len(next(iter(lanes.state.values()))):
            lanes.slots = {0: 0}
        columns = {c: pd.to_numeric(pdf[c].astype(object).where(pdf[c].notna(), None)).to_numpy() if c in pdf else np.full(len(pdf), np.nan) for c in self.machine.columns}
        columns = {c: x.astype(np.int64 if c == "ts_ms" else float) for c, x in columns.items()}
        at, made = lanes.advance(np.zeros(len(pdf), np.int64), columns)
        self.store(lanes.state)
        names = [f.split()[0] for f in self.machine.schema.split(", ")]
        yield pd.concat([pdf[self.keep].iloc[at].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)


class Trips(Stepped):
    machine, keep = TripMachine(), ["vehicle_pid", "tenant_id"]


TRIPS = "vehicle_pid string, tenant_id int, " + TripMachine.schema
REORDERED = "vehicle_pid string, tenant_id int, ts_ms bigint, seq bigint, lat_e6 int, lon_e6 int, speed_kmh double, ignition boolean, late boolean"


class Reorder(Stored):
    """Per-vehicle reorder with deduplication by (time, seq) in the buffer's span; a processing-time timer flushes a silent vehicle."""

    columns = [f.split()[0] for f in REORDERED.split(", ")]

    def handleInputRows(self, key, rows, timerValues):
        held, mark, seen = self.load() or (None, Mark(), set())
        new = pd.concat(list(rows)).sort_values("arrival")[self.columns[:-1]].drop_duplicates(["ts_ms", "seq"])
        new = new[[x not in seen for x in zip(new["ts_ms"], new["seq"], strict=True)]]
        both = pd.concat([held, new], ignore_index=True) if held is not None and len(held) else new.reset_index(drop=True)
        left, late, stay, mark = released(both["ts_ms"].to_numpy(np.int64), both["seq"].to_numpy(np.int64), len(both) - len(new), mark, REORDER)
        seen |= set(zip(new["ts_ms"], new["seq"], strict=True))
        self.store((both.iloc[stay], mark, {x for x in seen if x[0] > mark.top - 10 * REORDER.lateness_ms}))
        out = pd.concat([both.iloc[left].assign(late=False), both.iloc[late].assign(late=True)])
        yield out[self.columns].astype(object).where(out[self.columns].notna(), None)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + REORDER.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.load()
        if state is not None and state[0] is not None and len(state[0]):
            held, mark, seen = state
            self.store((held.iloc[:0], Mark(mark.top, max(mark.gone, int(held["ts_ms"].max()))), seen))
            yield held.sort_values(["ts_ms", "seq"]).assign(late=False)[self.columns]

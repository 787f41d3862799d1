"""The drawdown breaker as a stateful stream: NAV updates, resets and orders of a portfolio in the order of their times, however batches cut them.

Rows wait in map state, in sorted pieces, until the watermark has passed them; an event-time timer then releases all that are due, in order.
An order is answered by the breaker's state at its time. State is a peak, a flag and what arrived within the delay.
A task holds RUN_ROWS rows of a portfolio; what more is due goes through sorted files of the task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of the input; kind: nav, reset or order, which is also their order at one time.
INPUT = "portfolio string, time timestamp, seq long, kind string, nav double"
OUTPUT = "portfolio string, time timestamp, seq long, kind string, nav double, drawdown double, halted boolean, allowed boolean"
KINDS = ("nav", "reset", "order")
#: Due rows of a portfolio that are sorted in memory (25 bytes each and their index); what is beyond goes to sorted files.
RUN_ROWS = 1 << 20
#: Rows of a sorted file that are read at once, of a piece of state and of a piece of the result.
BLOCK = 1 << 14
_ROW = np.dtype([("at", "<i8"), ("seq", "<i8"), ("nav", "<f8"), ("kind", "i1")])


def _ordered(rows: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(rows)
    return out[np.lexsort((out["seq"], out["kind"], out["at"]))]


def _until(rows: np.ndarray, last: np.void) -> int:
    """How many of sorted rows come no later than the row `last`."""
    at, kind, seq = last["at"], last["kind"], last["seq"]
    return int(((rows["at"] < at) | (rows["at"] == at) & ((rows["kind"] < kind) | (rows["kind"] == kind) & (rows["seq"] <= seq))).sum())


def _merged(pieces: Iterator[np.ndarray], run_rows: int, block: int) -> Iterator[np.ndarray]:
    """All rows of the pieces in order, in parts; in memory are run_rows rows and a piece, then a block of each sorted file."""
    held: list[np.ndarray] = []
    with tempfile.TemporaryDirectory() as folder:
        files = 0
        for piece in pieces:
            held.append(piece)
            if sum(map(len, held)) >= run_rows:
                _ordered(held).tofile(f"{folder}/{files}")
                files, held = files + 1, []
        rest = _ordered([*held, np.zeros(0, _ROW)])
        held = []
        if not files:
            yield from (rest[i : i + block] for i in range(0, len(rest), block))
            return
        rest.tofile(f"{folder}/{files}")
        rest = rest[:0].copy()
        places, parts = [0] * (files + 1), [np.zeros(0, _ROW)] * (files + 1)
        while True:
            more = []
            for i, part in enumerate(parts):
                read = np.fromfile(f"{folder}/{i}", _ROW, block - len(part), offset=places[i] * _ROW.itemsize) if places[i] >= 0 else part[:0]
                parts[i] = np.concatenate((part, read))
                places[i] = places[i] + len(read) if len(parts[i]) == block else -1  # the file's end
                if places[i] >= 0:
                    more.append(parts[i][-1])
            cuts = [min((_until(part, last) for last in more), default=len(part)) for part in parts]
            out = _ordered([part[:n] for part, n in zip(parts, cuts, strict=True)])
            parts = [part[n:] for part, n in zip(parts, cuts, strict=True)]
            yield from (out[i : i + block] for i in range(0, len(out), block))
            if not more:
                return


class Breaker(StatefulProcessor):
    def __init__(self, limit: float, run_rows: int = RUN_ROWS, block: int = BLOCK):
        self.limit, self.run_rows, self.block = limit, run_rows, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "n long, first long", "rows binary")
        self.pieces = handle.getValueState("pieces", "n long")
        self.now = handle.getValueState("now", "peak double, halted boolean, nav double")
        self.timer = handle.getValueState("timer", "at long")

    def _keep(self, rows: list[np.ndarray]) -> None:
        """Puts rows into state as a piece; pieces are numbered in the order in which they came."""
        piece = _ordered(rows)
        n = self.pieces.get()[0] if self.pieces.exists() else 0
        self.waiting.updateValue((n, int(piece["at"][0])), (piece.tobytes(),))
        self.pieces.update((n + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            piece = np.zeros(len(part), _ROW)
            piece["at"] = part["time"].astype("datetime64[us]").astype("int64")
            piece["seq"], piece["kind"], piece["nav"] = part["seq"].astype("int64"), part["kind"].map(KINDS.index), part["nav"].astype(float)
            self._keep([piece])
            latest = max(int(piece["at"].max()), latest or int(piece["at"].max()))
        if latest is not None:
            due = latest // 1000 + 1
            if not self.timer.exists() or self.timer.get()[0] < due:
                self.handle.registerTimer(due)
                self.timer.update((due,))
        return iter(())

    def _due(self, passed: int) -> Iterator[np.ndarray]:
        """Takes what has come to its time out of the state, piece by piece; what remains of pieces is put together."""
        later: list[np.ndarray] = []
        for n, first in sorted(self.waiting.keys()):
            if first > passed:
                continue
            rows = np.frombuffer(self.waiting.getValue((n, first))[0], _ROW)
            self.waiting.removeKey((n, first))
            cut = int(np.searchsorted(rows["at"], passed, "right"))
            if cut < len(rows):
                later.append(rows[cut:].copy())
                if sum(map(len, later)) >= self.block:
                    self._keep(later)
                    later = []
            yield rows[:cut]
        if later:
            self._keep(later)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        peak, halted, nav = self.now.get() if self.now.exists() else (0.0, False, 0.0)
        for rows in _merged(self._due(timerValues.getCurrentWatermarkInMs() * 1000), self.run_rows, self.block):
            place, kind = np.arange(len(rows)), rows["kind"]
            known = (kind == KINDS.index("nav")) & ~np.isnan(rows["nav"])
            last = lambda which: np.maximum.accumulate(np.where(which, place, -1))  # noqa: E731,B023
            of = last(known)
            navs = np.where(of >= 0, rows["nav"][of], nav)
            peaks = np.maximum(np.maximum.accumulate(np.where(known, rows["nav"], -np.inf)), peak)
            drawdown = np.full(len(rows), np.nan)  # before the first NAV
            with np.errstate(invalid="ignore"):
                np.divide(navs - peaks, peaks, out=drawdown, where=peaks > 0)
            fell, reset = last(known & (drawdown < -self.limit)), last(kind == KINDS.index("reset"))
            halts = np.where(np.maximum(fell, reset) < 0, halted, fell > reset)
            allowed = np.where(kind == KINDS.index("order"), (~halts).astype(object), None)
            time = rows["at"].astype("datetime64[us]")
            yield pd.DataFrame({"portfolio": key[0], "time": time, "seq": rows["seq"], "kind": np.array(KINDS, object)[kind], "nav": np.where(known, rows["nav"], np.nan), "drawdown": drawdown, "halted": halts, "allowed": allowed})
            peak, halted, nav = float(peaks[-1]), bool(halts[-1]), float(navs[-1])
        self.now.update((peak, halted, nav))

    def close(self) -> None:
        pass


def answered(events: DataFrame, delay: str = "1 hour", limit: float = config.DRAWDOWN_LIMIT, run_rows: int = RUN_ROWS, block: int = BLOCK) -> DataFrame:
    """A stream of events (INPUT) with drawdown and halted after each, and of orders whether they are allowed.

    A NAV beyond the limit below its peak halts until a reset; a reset keeps the peak. At one time NAVs come first, then resets, then
    orders, each by seq. Rows come out once the watermark has passed them: events may be late by the delay, later ones are dropped. A null
    NAV changes nothing."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withWatermark("time", delay).groupBy("portfolio").transformWithStateInPandas(Breaker(limit, run_rows, block), OUTPUT, "Append", "EventTime")

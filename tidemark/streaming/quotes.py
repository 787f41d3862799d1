"""Quote streams: validation, idempotent keys, tumbling bars, a stateful drawdown latch."""

from __future__ import annotations

import heapq
import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config
from ..sources import store

#: Rows of one portfolio's batch that latch() sorts in memory (18 bytes each and their index); what is beyond goes to sorted files of the task.
RUN_ROWS = 1 << 22
#: Rows of a sorted file that are read at once, and of a piece of the result.
BLOCK = 10_000
_UPDATE = np.dtype([("no_at", "?"), ("at", "i8"), ("nav", "f8"), ("reset", "?")])


def valid(quotes: DataFrame) -> DataFrame:
    """Quotes with positive sides and ask at least bid, with mid and spread."""
    bid, ask = F.coalesce("bid", F.lit(0.0)), F.coalesce("ask", F.lit(0.0))
    kept = quotes.where((bid > 0) & (ask > 0) & (ask >= bid))
    mid = (F.col("bid") + F.col("ask")) / 2
    return kept.withColumn("mid", mid).withColumn("spread_bps", (F.col("ask") - F.col("bid")) / F.col("mid") * 1e4)


def deduplicated(quotes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Once per (time, symbol); works on streams, with a watermark, and on batches."""
    return valid(quotes).withWatermark("time", delay).dropDuplicates(["time", "symbol"])


def bars(quotes: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    w = valid(quotes).withWatermark("time", delay).groupBy(F.window("time", width), "symbol")
    out = w.agg(F.min_by("mid", "event_id").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", "event_id").alias("close"), F.count("*").alias("ticks"))
    return out.select(F.col("window.start").alias("time"), "symbol", "open", "high", "low", "close", "ticks")


def liveness(quotes: DataFrame, now) -> DataFrame:
    """The latest tick and whether it is less than a minute old."""
    last = quotes.orderBy(F.desc("time"), F.desc("event_id")).limit(1)
    return last.select("symbol", "time", (F.lit(now).cast("timestamp").cast("double") - F.col("time").cast("double") < 60).alias("active"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of quotes."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("symbol"), (F.col("value") - 0.5).alias("bid"), (F.col("value") + (F.col("event_id") % 5) * 0.25 - 0.25).alias("ask"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns its rows (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upserted(stream: DataFrame, path: str, state: str, key: tuple[str, ...] = ("time", "symbol"), every: str | None = "5 seconds") -> StreamingQuery:
    """Starts a query that appends to a Parquet table by day what each batch has of new keys; every None: all that is there, then it ends.

    A batch reads the days that it touches, not the table. One that is replayed after a failure finds its keys there already and appends nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        store.merge(batch.sparkSession, path, batch.withColumn("day", F.to_date(key[0])), list(key))

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.option("checkpointLocation", state).trigger(**trigger).foreachBatch(append).start()


def _ordered(parts: Iterator[pd.DataFrame], folder: str, run_rows: int) -> Iterator[tuple]:
    """Every row of a group's chunks as (no_at, at, nav, reset), by at, then nav and reset, nulls last."""
    runs, held = [], []

    def run() -> np.ndarray:
        rows = np.concatenate(held)
        held.clear()
        return rows[np.lexsort((rows["reset"], rows["nav"], rows["at"], rows["no_at"]))]

    def read(rows: np.ndarray) -> Iterator[tuple]:
        return itertools.chain.from_iterable(rows[i : i + BLOCK].tolist() for i in range(0, len(rows), BLOCK))

    for part in parts:
        rows = np.zeros(len(part), _UPDATE)
        rows["no_at"], rows["at"], rows["nav"], rows["reset"] = part["at"].isna(), part["at"].fillna(0), part["nav"], part["reset"].eq(True)
        held.append(rows)
        if sum(map(len, held)) >= run_rows:
            np.save(f"{folder}/{len(runs)}.npy", run())
            runs.append(np.load(f"{folder}/{len(runs)}.npy", mmap_mode="r"))
    if held:
        runs.append(run())
    return heapq.merge(*map(read, runs), key=lambda r: (r[0], r[1], r[2] != r[2], r[2] if r[2] == r[2] else 0.0, r[3]))


def latch(nav: DataFrame, limit: float = config.DRAWDOWN_LIMIT, run_rows: int = RUN_ROWS) -> DataFrame:
    """A stream of (portfolio, at long, nav, reset boolean) with drawdown and halted, by state per portfolio.

    Each batch of a portfolio is folded in the order of `at` as a whole (of equal ones by nav, then reset), however Spark
    cuts and orders it; rows of a later batch come after those of earlier ones. A task holds run_rows rows of a portfolio
    and a block of each sorted file, not the batch.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, halted = state.get if state.exists else (0.0, False)
        with tempfile.TemporaryDirectory() as folder:
            rows = _ordered(parts, folder, run_rows)
            while block := list(itertools.islice(rows, BLOCK)):
                down, out = [], []
                for _, _, value, reset in block:
                    peak = max(peak, value)
                    drawdown = (value - peak) / peak if peak > 0 else 0.0
                    halted = False if reset else halted or drawdown < -limit
                    down.append(drawdown)
                    out.append(halted)
                at = pd.array([None if r[0] else r[1] for r in block], "Int64")
                yield pd.DataFrame({"portfolio": [key[0]] * len(block), "at": at, "nav": [r[2] for r in block], "drawdown": down, "halted": out})
        state.update((peak, halted))

    return nav.groupBy("portfolio").applyInPandasWithState(step, "portfolio string, at long, nav double, drawdown double, halted boolean", "peak double, halted boolean", "append", GroupStateTimeout.NoTimeout)

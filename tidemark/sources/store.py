"""Sinks that can be repeated: upserts that read only the days they touch, a log of whole runs, gated writes, caches that know their inputs."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructType

from . import market

#: Days of a batch that are named in the scan's partition filter at most; beyond that the target is joined with the days.
MOST_DAYS = 1000
#: Committed runs that are broadcast to the log's scan at most.
MOST_RUNS = 100_000


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def touched(spark: SparkSession, path: str, rows: DataFrame, key: list[str], by: str) -> DataFrame | None:
    """What a table partitioned by `by` has of the days and the range of the first key column that rows have; None where there is no table.

    The days are a filter on partitions, the range a filter on Parquet's statistics: other days' files aren't opened."""
    if not market._exists(spark, path):
        return None
    there = spark.read.parquet(path)
    spans = rows.groupBy(by).agg(F.min(key[0]).alias("first"), F.max(key[0]).alias("last"))
    days = spans.limit(MOST_DAYS + 1).collect()
    if len(days) > MOST_DAYS:
        return there.join(spans.select(by), by, "left_semi")
    if not days:
        return there.limit(0)
    named = F.col(by).isin([r[0] for r in days if r[0] is not None])
    if any(r[0] is None for r in days):
        named = named | F.col(by).isNull()
    ends = [r for r in days if r.first is not None]
    if len(ends) == len(days):
        named = named & F.col(key[0]).between(min(r.first for r in ends), max(r.last for r in ends))
    return there.where(named)


def merge(spark: SparkSession, path: str, rows: DataFrame, key: list[str], by: str = "day") -> int:
    """Appends rows whose key isn't in the table yet (of equal keys the smallest row), and says how many. Repeating it adds nothing.

    key: not null; `by` is a function of it."""
    new = market.upsert(rows.limit(0), rows, key).select(rows.columns).persist()
    try:
        there = touched(spark, path, new, key, by)
        fresh = new if there is None else new.join(there.select(*key), key, "left_anti")
        seen = Observation()
        fresh.select(rows.columns).observe(seen, F.count("*").alias("n")).sortWithinPartitions(by, *key).write.mode("append").partitionBy(by).parquet(path)
        return seen.get["n"]
    finally:
        new.unpersist()


def replace(spark: SparkSession, path: str, rows: DataFrame, key: list[str], by: str = "day") -> None:
    """As merge(), but rows take the place of those with their keys: only the days that rows touch are written anew."""
    new = market.upsert(rows.limit(0), rows, key).select(rows.columns).persist()
    try:
        there = market._exists(spark, path) and spark.read.parquet(path).join(F.broadcast(new.select(by).distinct()) if new.select(by).distinct().count() <= MOST_DAYS else new.select(by).distinct(), by, "left_semi").select(rows.columns)
        whole = new if there is False else new.unionByName(there.join(new.select(*key), key, "left_anti"))
        # written first: Spark can't overwrite what it reads
        market.written(whole).sortWithinPartitions(by, *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    finally:
        new.unpersist()


def write_sorted(bars: DataFrame, path: str, by: str = "ticker", order: str = "date") -> None:
    """Bars in a folder a ticker, each file in the order of dates, so that a range of dates reads few row groups. Large tickers get several files, by date."""
    bars.repartitionByRange(by, order).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).parquet(path)


def windowed(spark: SparkSession, path: str, first: str, last: str, lookback: int, made: Callable[[DataFrame], DataFrame], tickers: list[str] | None = None, order: str = "date") -> DataFrame:
    """made(bars) of the dates from first to last, reading lookback calendar days more before them and the named tickers alone."""
    rows = spark.read.parquet(path)
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin(tickers))
    start = F.date_sub(F.lit(first).cast("date"), lookback)
    kept = rows.where((F.col(order) >= start) & (F.col(order) <= F.lit(last).cast("date")))
    return made(kept).where(F.col(order).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


class Log:
    """An append-only table of runs. A run is written to a folder of its attempt and counts once its commit record is there.

    A run that is repeated is left out, one that was killed between files is written again elsewhere: readers see every row of a
    run or none, and once. Later runs may bring further columns and wider numbers; `run` and `attempt` are columns of the log's own."""

    WIDER = {(IntegerType, LongType), (FloatType, DoubleType), (IntegerType, DoubleType)}

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.base = StructType.fromDDL(schema)

    def commits(self) -> DataFrame:
        """(run, attempt, rows, schema, at) of every commit."""
        schema = "run string, attempt string, rows long, schema string, at timestamp"
        if not market._exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.path}/commits")

    def schema(self) -> StructType:
        """All columns of all commits. There are as many schemas as the table has had, however many runs."""
        out = self.base
        for schema in sorted(r.schema for r in self.commits().select("schema").distinct().collect()):
            out = self.widened(out, StructType.fromJson(json.loads(schema)))
        return out

    @classmethod
    def widened(cls, a: StructType, b: StructType) -> StructType:
        kinds = {f.name: f.dataType for f in a}
        for f in b:
            old = kinds.setdefault(f.name, f.dataType)
            if old != f.dataType:
                if (type(old), type(f.dataType)) in cls.WIDER:
                    kinds[f.name] = f.dataType
                elif (type(f.dataType), type(old)) not in cls.WIDER:
                    raise ValueError(f"column {f.name}: {f.dataType.simpleString()} after {old.simpleString()}")
        out = StructType()
        for name, kind in kinds.items():
            out.add(name, kind)
        return out

    def append(self, rows: DataFrame, run: str) -> bool:
        """Writes rows as the run of that name; False, and nothing written, if it has been committed already."""
        if not re.fullmatch(r"[\w.-]+", run):
            raise ValueError("a run's name has letters, digits, _, . and - alone")
        record = f"{self.path}/commits/{run}.json"
        if market._exists(self.spark, record):
            return False
        self.widened(self.schema(), rows.schema)
        attempt, seen = uuid.uuid4().hex, Observation()
        rows.observe(seen, F.count("*").alias("n")).write.parquet(f"{self.path}/data/run={run}/attempt={attempt}")
        return self._commit(record, {"run": run, "attempt": attempt, "rows": seen.get["n"], "schema": rows.schema.json()})

    def _commit(self, record: str, what: dict) -> bool:
        """Puts the record in place by a rename; False if another attempt was faster."""
        fs, at = _fs(self.spark, record)
        _, aside = _fs(self.spark, f"{self.path}/pending/{what['attempt']}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(what | {"at": datetime.now(UTC).isoformat()}).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, False)
            return False
        return True

    def read(self) -> DataFrame:
        """All rows of committed runs, with `run`; columns that a run didn't have are null."""
        schema = self.schema()
        done = self.commits().select("run", "attempt")
        if not market._exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], schema).withColumn("run", F.lit(""))
        whole = StructType([*schema.fields]).add("run", "string").add("attempt", "string")
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        few = done.limit(MOST_RUNS + 1).count() <= MOST_RUNS
        return rows.join(F.broadcast(done) if few else done, ["run", "attempt"], "left_semi").select(*(f.name for f in schema), "run")


def gated(rows: DataFrame, path: str, hard: dict[str, Column], soft: dict[str, Column] | None = None) -> dict[str, int]:
    """Writes rows to a new table in one scan that also counts rows and soft issues; a row with a hard issue fails the write, and no table is left."""
    spark, seen = rows.sparkSession, Observation()
    counts = [F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in (soft or {}).items())]
    issue = F.coalesce(*(F.when(c, F.lit(n)) for n, c in hard.items())) if hard else F.lit(None).cast("string")
    what = F.concat(F.lit("bad row: "), issue, F.lit(" "), F.to_json(F.struct(*rows.columns)))
    passed = F.when(issue.isNotNull(), F.raise_error(what).cast("boolean")).otherwise(F.lit(True))
    if market._exists(spark, path):
        raise FileExistsError(path)
    try:
        rows.observe(seen, *counts).where(passed).write.parquet(path)
    except Exception:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
        raise
    return seen.get


def files_digest(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of all files under the paths; listed and hashed by Spark, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([*paths]).select("path", "length", "modificationTime")
    h = F.xxhash64("path", "length", "modificationTime")
    r = files.agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.sum(h.cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n} {r.b} {r.h}"


def cached(spark: SparkSession, root: str, inputs: list[str], parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written once for each state of the input files and each set of parameters: a change of either recomputes."""
    version = hashlib.sha256(json.dumps([files_digest(spark, *inputs), parameters], sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = f"{root.rstrip('/')}/{version}"
    if not market._exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Helpers that the corpus operators share: tables, shared storage, numpy text, graph components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Graphs of at most this many links are finished by one bounded task (16 bytes a link).
ONE_TASK_LINKS = 200_000
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, a folder
    that goes with the process. What is written there on a cluster stays until that folder is cleared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once to shared storage and returns a scan of it, so that lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As materialise(), in buckets by key, so that what groups by it needs no shuffle of these rows; the catalog's entry is dropped at once."""
    spark, path, name = df.sparkSession, shared_folder(df.sparkSession), f"tidemark_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return written


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: whole texts travel in them, and both sides of a worker's pipe hold several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Returns to the system what the Arrow pool and the C heap keep: workers serve many tasks, and kept peaks add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(made: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its task ends."""

    @functools.wraps(made)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(batches)
        finally:
            give_back()

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text; null counts as empty."""
    data, offsets = utf8(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over the whole of it."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefixes:
    """Hashes of any slices of a sequence, from prefix sums of value times power, all modulo 2**64.

    Slices above SHORT values need hashes of another kind (see words()): with a power of two as modulus there are different
    sequences of some hundred values that meet whatever the base is.
    """

    SHORT = 32

    BASE = 0x9E3779B97F4A7C15
    VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    @classmethod
    def grown(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.powers) <= n:
            size = max(2 * len(cls.powers), n + 1, 1 << 16)
            for name, base in (("powers", cls.BASE), ("inverses", pow(cls.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.powers, cls.inverses

    def __init__(self, values: np.ndarray):
        powers, self.back = self.grown(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Prefixes:
        return cls(cls.VALUES[data])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def words(self, starts: np.ndarray, ends: np.ndarray, raw: Callable[[int, int], bytes]) -> np.ndarray:
        """Hashes of slices of any length, the long ones by a digest of their raw bytes."""
        out = self.slices(starts, ends)
        for i in np.flatnonzero(ends - starts > self.SHORT).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw(int(starts[i]), int(ends[i])), digest_size=8).digest(), "little")
        return out


def forest(links: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Each node of the links with the smallest node of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for u, v in links:
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = forest([(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches])
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["node", "component"])


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component) for every node of the links (two long columns); component is its smallest reachable node.

    Alternates large-star and small-star steps, each two shuffles on node ids, until the links are stars; each
    round's links are a written table. When few enough links are left, one task with a bounded input ends it.
    Nodes without a link don't appear; null ends are dropped.
    """
    u, v = links.columns
    links = links.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    links = materialise(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n <= one_task:
            return links.coalesce(1).mapInArrow(_one_task, "node long, component long")
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = materialise(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct())
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        links = materialise(links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())

"""Quality classifier by compression: one zstandard dictionary of good text, one of bad text.

A text is compressed with both. The difference of the two compressed sizes over its length becomes a probability by logistic
calibration on labelled rows that went into neither dictionary, together with the smaller of the two sizes over the
length: by the difference alone text that repeats itself passes as good (README has the figures).

Only labelled rows outside the held-out fold are learnt from, at most MAX_TRAIN of them by the order of a hash of the
document id; of those, two thirds feed the dictionaries, each with a slice, and one third, whole, the calibration.
Tasks cut the slices and compress; only slices and features reach the driver. Everything is scored.
Nulls: a null text scores as an empty one. Empty texts get the score of the calibration at zero difference. Rows of
labels with a null doc_id or quality, and repeated labels that contradict one another, teach nothing. Empty tables
of labels give the constant score 0.5. Extra columns are carried by score() and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, small_batches, table

#: Labelled rows that training may use.
MAX_TRAIN = 6000
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3
PIECE = 1 << 16


class Model:
    """Two dictionaries and the calibration; small enough (a few hundred kB) to go with each task."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights
        self._pair = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_pair": None}

    def features(self, text: bytes) -> list[float]:
        """1, signed size difference per byte (in per cent), size per byte under the better dictionary."""
        if self._pair is None:
            self._pair = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=LEVEL, write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        n = len(text)
        if not n:
            return [1.0, 0.0, 0.0]
        a, b = (sum(len(c.compress(text[i : i + PIECE])) for i in range(0, n, PIECE)) for c in self._pair)
        return [1.0, 100.0 * (b - a) / (n + 64), min(a, b) / (n + 64)]

    def score(self, text: bytes) -> float:
        if not self.good or not self.bad:
            return 0.5
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _slices(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(start, bytes) of a slice of each text, size bytes in all at most, from all parts of the texts; what short texts leave goes to longer ones."""
    n, left, out = len(lengths), size, [(0, 0)] * len(lengths)
    for k, i in enumerate(sorted(range(n), key=lengths.__getitem__)):
        share = min(lengths[i], left // (n - k))
        out[i] = ((lengths[i] - share) * i // max(1, n - 1), share)
        left -= share
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton steps on the log loss with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([0] + [1e-2] * (x.shape[1] - 1)) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The model from at most max_train labelled rows outside the held-out fold."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    clean = clean.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    chosen = None
    for q in (0, 1):
        best = clean.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        chosen = best if chosen is None else chosen.unionByName(best)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "q")), "doc_id").where("text is not null and text != ''").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("q").alias("q"))
    texts = materialise(texts.select("doc_id", "q", F.col("text").cast("binary").alias("raw")))
    rows = texts.select("doc_id", "q", F.octet_length("raw").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    parts = {(q, part): [r for i, r in enumerate(x for x in rows if x.q == q) if (i % 3 == 2) == part] for q in (0, 1) for part in (False, True)}
    if not all(parts.values()):
        return Model(b"", b"", [0.0] * 3)
    key = docs.schema["doc_id"].dataType.simpleString()
    cuts = {r.doc_id: cut for q in (0, 1) for r, cut in zip(parts[q, False], _slices([r.n for r in parts[q, False]], DICTIONARY_BYTES), strict=True)}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(d, x[cuts[d][0] : sum(cuts[d])]) for d, x in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), strict=True) if d in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], b.schema.field("doc_id").type), pa.array([x for _, x in got], pa.binary())], ["doc_id", "piece"])

    pieces = {r.doc_id: bytes(r.piece) for r in texts.select("doc_id", "raw").mapInArrow(cut_out, f"doc_id {key}, piece binary").collect()}
    good, bad = (b"".join(pieces[r.doc_id] for r in parts[q, False]) for q in (1, 0))
    model = Model(good, bad, [0.0] * 3)
    held = docs.sparkSession.sparkContext.broadcast((model, {r.doc_id for q in (0, 1) for r in parts[q, True]}))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted = held.value
        for b in batches:
            got = [(d, q, model.features(x)) for d, q, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "q", "raw")), strict=True) if d in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in got], b.schema.field("doc_id").type), pa.array([q for _, q, _ in got], pa.int32()), pa.array([x for _, _, x in got], pa.list_(pa.float64()))], ["doc_id", "q", "x"])

    found = sorted(texts.select("doc_id", "q", "raw").mapInArrow(measured, f"doc_id {key}, q int, x array<double>").collect(), key=lambda r: r.doc_id)
    model.weights = _logistic(np.array([list(r.x) for r in found]), np.array([r.q for r in found], float))
    return model


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a column of the given name (replacing one of that name)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, `{name}` double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [held.value.score(t.encode()) for t in (x or "" for x in b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, name])

    return kept.mapInArrow(scored, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary classifier over hashed byte n-grams (orders 2 to 4
of the lower-cased text) tells the two halves of the languages apart: a linear model of smoothed log-odds, whose mean
margin is calibrated on training rows that it hasn't counted. A text gets the language whose codeword costs least,
each bit's logistic loss being weighted by that bit's reliability; the score is the share of the best codeword among
all, and `ambiguous` flags texts whose two nearest codewords lie within AMBIGUOUS of one another.

Learnt only from text and lang of rows outside the held-out fold: about PER_LANG rows a language, those with the least hashes
of id and text, and all rows of a language that has fewer; whole texts. Three quarters of them are counted, one quarter
calibrates. Tasks count and measure; the driver gets a row of counts a language and a row of margins a calibration row.
Every row is predicted from its whole text.
Nulls: a null text, and one without a letter, is `und` with score 0; a null lang or doc_id teaches nothing, and a null
doc_id is not held out. With no rows to learn from all texts are `und`; with a single language all get that one. Extra
columns don't matter.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, materialise, small_batches, table

PER_LANG = 1200
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
FOLDS = 5
AMBIGUOUS = 0.2
#: Texts are read in pieces of so many bytes, to bound memory.
PIECE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """A row of +1/-1 for each of n languages: every split in two for up to six languages, random splits beyond."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([[1] * len(columns), *zip(*columns, strict=True)], np.int8)
    draw, columns = random.Random(n), set()
    while len(columns) < 4 * n.bit_length() + 16:
        c = [1] * (n // 2) + [-1] * (n - n // 2)
        draw.shuffle(c)
        columns.add(tuple(x * c[0] for x in c))
    return np.array(sorted(columns), np.int8).T


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, piece by piece."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for a in range(0, len(data), PIECE):
        x = data[a : a + PIECE + max(ORDERS) - 1].astype(np.uint32)
        for order in ORDERS:
            if len(x) >= order:
                h = x[: len(x) - order + 1].copy()
                for k in range(1, order):
                    h = h * np.uint32(0x01000193) ^ x[k : len(x) - order + 1 + k]
                h *= np.uint32(0x9E3779B1)
                yield (h >> np.uint32(16)) ^ np.uint32(order * 0x1111)


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, slopes: np.ndarray, reliability: np.ndarray):
        self.langs, self.weights, self.slopes, self.reliability, self.codes = langs, weights, slopes, reliability, codewords(len(langs))

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether a second language is nearly as close."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        z = self.slopes[:, 0] + self.slopes[:, 1] * self.margins(text)
        loss = (np.logaddexp(0, -self.codes * z) * self.reliability).sum(1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best, second = np.argsort(-share, kind="stable")[:2]
        return self.langs[best], float(share[best]), bool(share[best] - share[second] < AMBIGUOUS)


def _slope(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic calibration of margins m against bits y of 0 and 1."""
    scale = max(float(np.abs(m).mean()), 1e-9)
    x, w = np.stack([np.ones(len(m)), m / scale], 1), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * w)
    return w / np.array([1, scale])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, counts) of a task's rows (lang, text)."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for g in grams(text.as_py()):
                own += np.bincount(g, minlength=BUCKETS)
    pack = zstandard.ZstdCompressor(level=1).compress
    yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([pack(x.tobytes()) for x in counts.values()], pa.binary())], ["lang", "counts"])


def _summed(rows: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    total = np.zeros(BUCKETS, np.int64)
    for x in rows.column("counts"):
        total += np.frombuffer(unpack(x.as_py()), np.int64)
    return pa.table({"lang": rows.column("lang")[:1], "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
    share = F.broadcast(learn.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    chosen = learn.join(share, "lang").where(draw < F.col("share"))
    chosen = materialise(chosen.select("lang", "text", (F.pmod(F.xxhash64("text", "doc_id"), F.lit(4)) == 3).alias("kept")))
    sums = chosen.where("not kept").select("lang", "text").mapInArrow(lean(_counted), "lang string, counts binary").groupBy("lang").applyInArrow(_summed, "lang string, counts binary").collect()
    langs = sorted(r.lang for r in sums)
    if len(langs) < 2:
        langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())[:1] if not langs else langs
        return Model(langs, np.zeros((1, 1), np.float32), np.zeros((1, 2)), np.ones(1))
    codes = codewords(len(langs))
    found = {r.lang: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), np.int64).astype(float) for r in sums}
    counts = np.stack([found[x] for x in langs])
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    weights = []
    for bit in codes.T:
        a, b = (share[bit == s].mean(0) + 1e-7 for s in (1, -1))
        weights.append(np.log(a) - np.log(b))
    model = Model(langs, np.ascontiguousarray(np.stack(weights, 1), np.float32), np.zeros((codes.shape[1], 2)), np.ones(codes.shape[1]))
    held = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.value.margins(t.as_py()).tolist() for t in b.column(1)], pa.list_(pa.float64()))], ["lang", "margins"])

    rows = chosen.where("kept").where(F.col("lang").isin(langs)).select("lang", "text").mapInArrow(lean(measured), "lang string, margins array<double>").collect()
    if rows:
        rows = sorted(rows)
        m, y = np.array([r.margins for r in rows]), np.array([(codes[langs.index(r.lang)] + 1) // 2 for r in rows])
        model.slopes = np.stack([_slope(m[:, k], y[:, k]) for k in range(codes.shape[1])])
        right = ((model.slopes[:, 0] + model.slopes[:, 1] * m > 0) == y).mean(0)
        model.reliability = np.clip(2 * right - 1, 0.05, 1)
    else:  # too few rows to calibrate: margins as they are
        model.slopes[:, 1] = 1.0
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [held.value.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return identify(docs, train(docs.select("doc_id", "text", "lang"))).withColumn("held_out", F.coalesce(fold == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")

"""Best-two-fit packing of documents' token ids into sequences of a fixed capacity.

1.  Pieces: tasks encode each text and cut what is longer than the capacity; the pieces, with their ids, are a written table.
    White space is never part of a token here, so words, or where a text has characters that aren't plain the runs between white space,
    are encoded by themselves and remembered by the worker.
2.  Plan: pieces of one length are interchangeable, so the packing needs only how many there are of each length, a number for each
    length up to the capacity. A sequence is filled greedily with the longest pieces that fit; then its smallest piece
    gives way to the two unpacked pieces that fill the expanded gap most tightly, if they fill it better. The same filling is
    repeated as often as the counts allow, so the plan's size depends on the capacity alone, never on the documents.
3.  Places: pieces are numbered within their length, and a piece's number gives its sequence and offset in the plan. Numbers
    come from many cells a length, each moved up by the counts of the cells before it; no task holds a whole length.

Nulls: a null text is an empty one and has the end id alone. A null doc_id is packed like any other. Repeated rows are packed each.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import library, tokenizer_path
from .shared import BATCH_ROWS, lean, materialise, small_batches, table, texts

CAPACITY = 2048
END_ID = 0
#: Bytes that a worker remembers of runs and their ids, and of words and theirs, about, and what an entry takes besides.
RUN_BYTES, WORD_BYTES, ENTRY = 64 << 20, 128 << 20, 180
#: Rows that are encoded together.
ENCODED_ROWS = 250
#: ASCII white space, printable ASCII and Latin letters that are single code points in either case, and the tokenizer's pattern for them in lower case.
PLAIN = re.compile(r"[!-~\t-\r \u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
WORDS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\u00df-\u00f6\u00f8-\u017f\t-\r ]+")
SPEC_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Cells of a length at least, and rows of a cell, about, beyond that.
CELLS, CELL_ROWS = 1024, 20_000
#: Bits of a piece's number within its length.
NUMBER_BITS = 48


class Ids(dict):
    """The ids, as bytes of little-endian unsigned 32-bit integers, of strings that the tokenizer encodes by themselves; each is made when it is
    first asked for."""

    def __init__(self, made: Callable[[str | bytes], bytes], most: int):
        self.made, self.size, self.most = made, 0, most

    def __missing__(self, key: str | bytes) -> bytes:
        ids = self[key] = self.made(key)
        self.size += len(key) + len(ids) + ENTRY
        return ids

    def bounded(self) -> None:
        """Cleared when it is large."""
        if self.size > self.most:
            self.clear()
            self.size = 0


class Runs:
    """Ids of texts. A plain text is put together from its words, of which case is dropped, and these go to the library's model alone.
    Other texts are cut into runs of characters without white space; a run that isn't plain itself goes through the whole tokenizer."""

    def __init__(self, path: str):
        self.library = library(path)
        self.cut = self.library.model.tokenize
        # fixed values: byte-level vocabularies write printable bytes as themselves and the others from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.spelling = [chr(b if b in own else next(others)) for b in range(256)]
        self.runs, self.words = Ids(self.one, RUN_BYTES), Ids(self.word, WORD_BYTES)

    def word(self, word: str) -> bytes:
        """A word is what the pre-tokenizer would pass on, but for the spelling of bytes."""
        return array("I", [t.id for t in self.cut(word if word.isascii() else "".join([self.spelling[b] for b in word.encode()]))]).tobytes()

    def plain(self, text: str) -> bytes | None:
        """None if the text isn't plain."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        return None

    def one(self, run: bytes) -> bytes:
        text = run.decode()
        ids = self.plain(text)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() if ids is None else ids

    def encoded(self, texts_: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        gc.disable()  # what is held here has no cycles, and a collection would go through all of it
        try:
            return [self._encoded(t) for t in texts_]
        finally:
            gc.enable()

    def _encoded(self, text: bytes) -> bytes:
        self.runs.bounded()
        self.words.bounded()
        ids = self.plain(text.decode())
        return b"".join(map(self.runs.__getitem__, text.split())) if ids is None else ids  # at ASCII white space alone


def by_runs(path: str) -> bool:
    """Whether the tokenizer is one that Runs can stand for: it drops white space and case and cuts words by the pattern of WORDS."""
    with open(path) as f:
        spec = json.load(f)
    cuts = spec["pre_tokenizer"] or {}
    pattern = [p["pattern"]["Regex"] for p in cuts.get("pretokenizers", []) if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])], [p["type"] for p in cuts.get("pretokenizers", [])]
    whole = all(not t["normalized"] and "<|" in t["content"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return whole and kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and pattern == [SPEC_WORDS]


@functools.cache
def runs(path: str) -> Runs:
    """One a worker process."""
    return Runs(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids), written: the ids of each row of docs (doc_id, text), end_id last, cut at multiples of capacity.

    ids: little-endian unsigned 32-bit integers. path: a tokenizer that drops white space and case and cuts words by the pattern of WORDS."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    docs = docs.select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = runs(path)
        for b in batches:
            rows, at, ids = [], [], []

            def made(keys: pa.Array = b.column(0)) -> pa.RecordBatch:
                lengths = np.array([len(x) // 4 for x in ids], np.int32)
                starts = np.array(at, np.int64)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array((starts // capacity).astype(np.int32)), pa.array(starts), pa.array(lengths), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

            slices = (found.encoded([t.tobytes() for t in texts(b.column(1).slice(a, ENCODED_ROWS))]) for a in range(0, b.num_rows, ENCODED_ROWS))
            for row, whole in enumerate(chain.from_iterable(slices)):
                whole += end
                for k in range(0, len(whole), 4 * capacity):
                    rows.append(row)
                    at.append(k // 4)
                    ids.append(whole[k : k + 4 * capacity])
                if len(ids) >= BATCH_ROWS:
                    yield made()
                    rows, at, ids = [], [], []
            if ids:
                yield made()

    return materialise(docs.mapInArrow(lean(cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids binary"))


class Plan:
    """Where the n-th piece of a length goes: ranges of numbers a length, by their first number."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        used = np.zeros(capacity + 1, np.int64)
        ranges, self.sequences = [], 0
        while left.any():
            bin_ = best_two(left, capacity)
            times = min(int(left[length]) // n for length, n in bin_.items())
            at = 0
            for length in sorted(bin_, reverse=True):
                n = bin_[length]
                ranges.append(((length << NUMBER_BITS) | int(used[length]), self.sequences, n, at))
                used[length] += n * times
                left[length] -= n * times
                at += n * length
            self.sequences += times
        #: Of each range: length and first number in one, its first sequence, how many of the length a sequence has, and the offset of the first of them.
        self.key, self.sequence, self.each, self.offset = np.array(sorted(ranges), np.int64).reshape(-1, 4).T.copy()

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces given by length and number within the length."""
        key = (length << NUMBER_BITS) | number
        i = np.searchsorted(self.key, key, "right") - 1
        n = key - self.key[i]
        return self.sequence[i] + n // self.each[i], self.offset[i] + n % self.each[i] * length


def best_two(left: np.ndarray, capacity: int) -> dict[int, int]:
    """One sequence: how many pieces of each length it takes from those left (counts by length)."""
    there = np.flatnonzero(left)
    bin_, gap = {}, capacity
    while True:
        i = np.searchsorted(there, gap, "right") - 1
        if i < 0:
            break
        length = int(there[i])
        bin_[length] = n = min(int(left[length]), gap // length)
        gap -= n * length
        there = there[:i]
    if not gap:
        return bin_
    smallest = min(bin_)
    rest = left.copy()
    for length, n in bin_.items():
        rest[length] -= n
    room = gap + smallest
    # the longest piece that is left up to each length, for every first piece the best second one
    first = np.flatnonzero(rest[: room + 1])
    longest = np.zeros(room + 1, np.int64)
    longest[first] = first
    longest = np.maximum.accumulate(longest)
    second = longest[room - first]
    alone = (second == first) & (rest[first] < 2)
    second[alone] = longest[np.maximum(first[alone] - 1, 0)]
    total = np.where(second > 0, first + second, 0)
    if len(total) and total.max() > smallest:
        k = int(total.argmax())
        bin_[smallest] -= 1
        if not bin_[smallest]:
            del bin_[smallest]
        for length in (int(first[k]), int(second[k])):
            bin_[length] = bin_.get(length, 0) + 1
    return bin_


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length and any more columns; a written table) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    cells = max(CELLS, -(-sum(counts.values()) // CELL_ROWS))
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    cut = cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(cells)).cast("int"))
    rest = [c for c in cut.columns if c not in ("doc_id", "piece", "_cell", "length")]
    sizes = cut.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    before = sizes.select("length", "_cell", (F.sum("n").over(Window.partitionBy("length").orderBy("_cell")) - F.col("n")).alias("_before"))
    numbered = cut.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", *rest)) - 1)
    placed = numbered.join(before, ["length", "_cell"]).withColumn("_number", F.col("_before") + F.col("_at")).drop("_cell", "_at", "_before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.places(b.column("length").to_numpy().astype(np.int64), b.column("_number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = [c for c in cut.columns if c != "_cell"]
    return placed.mapInArrow(place, ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long")


def sequences(cut: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, of cut (with ids) and its places; a sequence holds at most a capacity of ids."""
    keys = ["doc_id", "piece", "start"]
    rows = cut.select(*keys, "ids").join(places.select(*keys, "sequence_id", "offset"), keys)
    joined = rows.groupBy("sequence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x.ids), "").alias("hex"))
    number = lambda i: F.conv(F.concat(*(F.substr("hex", i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1))), 16, 10).cast("int")
    return joined.select("sequence_id", F.transform(F.sequence(F.lit(0), (F.length("hex") / 8 - 1).cast("int")), number).alias("ids"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")

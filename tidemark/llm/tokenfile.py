"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A segment holds whole documents; their ids, end to end, are cut into blocks of BLOCK ids. All blocks of a segment are
coded in lockstep, a numpy lane each, and every lane starts from the same model, so any block can be decoded by itself
with the segment's head. Per id: the order-2 table (by the last two ids) or else the order-1 table (by the last id)
predicts one id. The probability that it is right is mixed in the logistic domain from adaptive hit rates of order 2 and
order 1, by confidence and agreement, from the lane's running hit rate and from order 0 (the predicted id's share of the
segment), with weights that learn. A wrong prediction is followed by the id itself by its share, which the head holds as
counts. All of it is integer arithmetic, so files don't depend on the machine. A range coder with 64-bit state writes
32-bit words; the writer carries into words already written, so a reader needs the range and its own place in it only.

Segment format (little-endian): magic TMK2, u32 documents, u32 ids a block, u32 bytes of counts, u32 blocks; documents' ids
(i64) and id counts (u32); of each block its ids (u32), words (u32) and the crc32 of its ids (as u32); the different ids
(differences) and their counts (both u32, bytes of one rank together, zlib); the words. Segments are the rows of a Parquet
table in the shared folder, numbered by partition and place, in ascending doc_id order.

Nulls: a null text is empty and has the end id alone. A null doc_id sorts first. Rows that share a doc_id keep a row each.
A table without rows gives no segments.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, packing
from .shared import lean, materialise, table

MAGIC = b"TMK2"
HEAD = "<IIII"
BLOCK = 4096
#: Ids after which a segment is full; the last of a partition also takes what is left after it, less than as many again.
SEGMENT = 8_000_000
#: Text bytes of a partition, about.
PARTITION_BYTES = 32 << 20
END_ID = 1
#: Ids above those of any text, which is less than 2 GiB: documents stay whole.
WHOLE = 1 << 29
#: Entries of a lane's table of an order, as bits.
TABLE_BITS = 12
#: Order 0's shares add up to 2 to this power, or to a higher one where a segment has more different ids.
SHARE_BITS = 20
#: Ids below this are counted in an array.
COUNTED = 1 << 22
#: Ids that are counted or looked up together, and steps that are turned from blocks to lanes together.
PIECE, TURNED = 1 << 18, 64

_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-(x - 2048) / 256))))) for x in range(4096)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
#: What is added to how sure an entry is, by how sure it was, first where its id was wrong, then where it was right; a wrong one at 0 or 1 gives way.
_CHANGE = (np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7]) - np.tile(np.arange(8), 2)).astype(np.uint32)
_LOW, _WORD, _BIT = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(12)
_NEW, _THREE, _SEVEN, _EIGHT = np.uint32(1), np.uint32(3), np.uint32(7), np.uint32(8)
_HASH1, _HASH2, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(32 - TABLE_BITS)


class Shares:
    """Order 0: the different ids of a segment, ascending, and how often each is there. Lanes know an id by its place here."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        bits = max(SHARE_BITS, len(ids).bit_length() + 2)
        shares = 1 + counts * ((1 << bits) - len(ids)) // max(1, counts.sum())
        if len(ids):
            shares[counts.argmax()] += (1 << bits) - shares.sum()
        self.bits, self.shift, self.top = bits, np.uint64(bits), np.uint64((1 << bits) - 1)
        self.shares, self.below = shares, np.cumsum(shares) - shares
        self.low, self.wide = self.below.astype(np.uint64), shares.astype(np.uint64)
        self.stretched = _STRETCH.take(np.minimum(shares >> (bits - 12), 4095))
        self.wheres: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Shares, np.ndarray]:
        """Shares of the ids, and each id's place."""
        if len(ids) and int(ids.max()) < COUNTED:
            # by pieces, as numpy widens what it counts or looks up
            pieces = [slice(a, a + PIECE) for a in range(0, len(ids), PIECE)]
            counts, places = np.zeros(int(ids.max()) + 1, np.int64), np.empty(len(ids), np.uint32)
            for piece in pieces:
                counts += np.bincount(ids[piece], minlength=len(counts))
            there = np.flatnonzero(counts)
            to = np.zeros(len(counts), np.uint32)
            to[there] = np.arange(len(there))
            for piece in pieces:
                places[piece] = to.take(ids[piece])
            return cls(there, counts[there]), places
        there, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return cls(there.astype(np.int64), counts), places.astype(np.uint32)

    def packed(self) -> bytes:
        """By bytes of one rank, which makes them shorter."""
        return zlib.compress(np.concatenate((np.diff(self.ids, prepend=0), self.counts)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Shares:
        raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
        ids, counts = np.ascontiguousarray(raw.T).view("<u4").astype(np.int64).reshape(2, -1)
        return cls(np.cumsum(ids), counts)

    def find(self, points: np.ndarray) -> np.ndarray:
        """Whose share each point is in."""
        if self.bits > SHARE_BITS:
            return (np.searchsorted(self.below, points.astype(np.int64), "right") - 1).astype(np.uint32)
        if self.wheres is None:
            self.wheres = np.repeat(np.arange(len(self.ids), dtype=np.uint16 if len(self.ids) <= 1 << 16 else np.uint32), self.shares)
        return self.wheres.take(points.view(np.int64)).astype(np.uint32)


class Lanes:
    """The models and coder states of n blocks; words: of each lane the words to decode, or none to encode.

    What belongs to orders 2 and 1 stands in two rows of one array, so that a numpy call serves both."""

    def __init__(self, n: int, order0: Shares, block: int, words: np.ndarray | None = None):
        self.n, self.order0, self.steps = n, order0, 0
        # tables of all lanes lie end to end: one number finds an entry, the id seen and in the low 3 bits how sure it is
        self.seen = np.zeros(2 * n << TABLE_BITS, np.uint32)
        self.rate = np.full(2 * n * 16, 2048, np.int32)
        self.first, self.places = (np.arange(2 * n).reshape(2, n) << b for b in (TABLE_BITS, 4))
        # hit rates of the entries of this step, and in the last row of the lane
        self.rates = np.full((3, n), 2048, np.int32)
        self.weight = np.repeat(np.array([[26000], [20000], [8000], [0]], np.int32), n, 1)
        self.hash, self.before = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)
        self.range = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.decoding = words is not None
        # a bit and a share together fit what a range has at least, 32 bits, or else the range is looked at between the two
        self.apart = order0.bits + 12 > 32
        self.words = words if self.decoding else np.zeros((n, block * (1 + self.apart) + 4), np.uint32)
        self.flat = self.words.reshape(-1)
        self.start = np.arange(n) * self.words.shape[1]
        self.at, self.sizes = self.start.copy(), np.zeros(n, np.int64)
        # of the coder's range the start, or where in it the point to decode is
        self.low = np.zeros(n, np.uint64)
        if self.decoding:
            self.low = (words[:, 0].astype(np.uint64) << _WORD) | words[:, 1]
            self.at += 2

    def end(self, left: int) -> None:
        """Ends all lanes but the first ones."""
        if not self.decoding:
            at, low = self.at[left:], self.low[left:]
            self.flat[at], self.flat[at + 1] = low >> _WORD, low & _LOW
            self.sizes[left : self.n] = at + 2 - self.start[left : self.n]
        self.n = left
        for name in ("first", "places", "rates", "weight", "hash", "before", "range", "at", "low"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., :left]))

    def _move(self, by: np.ndarray) -> None:
        if self.decoding:
            self.low -= by
            return
        self.low += by
        lanes = np.flatnonzero(self.low < by)
        at = self.at.take(lanes)
        while len(at):  # a carry goes into the word before, and further where that becomes zero
            at -= 1
            self.flat[at] += np.uint32(1)
            at = at[self.flat[at] == 0]

    def _settle(self) -> None:
        """Moves a word out of, or into, lanes whose range has become short."""
        short = self.range <= _LOW
        shift = short * _WORD
        if not self.decoding:
            self.flat[self.at] = self.low >> _WORD  # where none is due the next one takes its place
        self.low <<= shift
        self.range <<= shift
        if self.decoding:
            self.low |= self.flat.take(self.at, mode="clip") * short
        self.at += short

    def _code(self, p: np.ndarray, guess: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes whether the guess is right, with probability p of 4096, and ids by their shares where it is wrong."""
        o = self.order0
        part = (self.range >> _BIT) * p.astype(np.uint64)
        hit = self.low < part if self.decoding else ids == guess
        self.range -= part
        np.copyto(self.range, part, where=hit)
        np.copyto(part, 0, where=hit)
        if self.apart or self.decoding:
            self._move(part)
        if self.apart:
            self._settle()
            part[:] = 0
        unit = self.range >> o.shift
        if self.decoding:
            ids = o.find(np.minimum(self.low // unit, o.top))
            np.copyto(ids, guess, where=hit)
        below = unit * o.low.take(ids)
        np.copyto(below, 0, where=hit)
        if not self.decoding:
            below += part
        self._move(below)
        unit *= o.wide.take(ids)
        np.copyto(self.range, unit, where=~hit)
        self._settle()
        return hit, ids

    def step(self, ids: np.ndarray | None = None) -> np.ndarray:
        """Codes the next id of each lane, as its place in order 0."""
        slots = (self.hash >> _SHIFT) + self.first
        entries = self.seen.take(slots)
        seen, sure = entries >> _THREE, entries & _SEVEN
        guess = np.where(sure[0] > 0, seen[0], seen[1])
        places = self.places + sure
        places += (seen[0] == seen[1]) * 8
        rates, weight = self.rates, self.weight
        rates[:2] = self.rate.take(places)
        inputs = np.empty((4, self.n), np.int32)
        _STRETCH.take(rates, out=inputs[:3], mode="clip")
        self.order0.stretched.take(guess, out=inputs[3], mode="clip")
        dot = (weight * inputs).sum(0, dtype=np.int32)
        dot >>= 16
        dot += 2048
        p = _SQUASH.take(dot, mode="clip")
        hit, out = self._code(p, guess, ids)
        aim = hit * np.int32(4095)
        inputs *= aim - p
        inputs >>= 10
        weight += inputs
        self.steps += 1
        if self.steps % 4 == 0:  # between two of these a weight moves by 33,000 at most, so sums of products stay below 2**31
            np.minimum(np.maximum(weight, -200_000, out=weight), 200_000, out=weight)
        change = aim - rates
        change >>= 5
        rates += change
        self.rate[places] = rates[:2]
        state = (seen == out) * _EIGHT
        state += sure
        entries += _CHANGE.take(state)
        np.copyto(entries, (out << _THREE) + _NEW, where=state <= _NEW)
        self.seen[slots] = entries
        np.multiply(out, _HASH1, out=self.hash[1])
        np.add(self.hash[1], self.before, out=self.hash[0])
        np.multiply(out, _HASH2, out=self.before)
        return out


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of documents whose ids stand end to end."""
    n = -(-len(ids) // block)
    order0, places = Shares.of(ids)
    lanes = Lanes(n, order0, block)
    places.resize(n * block, refcheck=False)
    grid = places.reshape(n, block)
    last = len(ids) - (n - 1) * block
    for t in range(block if n > 1 else last):
        if t % TURNED == 0:
            turned = np.ascontiguousarray(grid[:, t : t + TURNED].T)
        if t == last:
            lanes.end(n - 1)
        lanes.step(turned[t % TURNED, : lanes.n])
    lanes.end(0)
    sizes = np.full(n, block, np.uint32)
    if n:
        sizes[-1] = last
    sums = np.array([zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(n)], np.uint32)
    heads = np.stack((sizes, lanes.sizes.astype(np.uint32), sums)) if n else np.zeros((3, 0), np.uint32)
    keys = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    shares = order0.packed()
    return MAGIC + struct.pack(HEAD, len(keys), block, len(shares), n) + keys.tobytes() + np.array(counts, "<u4").tobytes() + heads.astype("<u4").tobytes() + shares + b"".join(lanes.words[i, : lanes.sizes[i]].astype("<u4").tobytes() for i in range(n))


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, id counts, and all ids end to end; raises ValueError where a checksum doesn't fit."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, block, shares, n = struct.unpack_from(HEAD, data, 4)
    at = 4 + struct.calcsize(HEAD)
    keys, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
    counts, at = np.frombuffer(data, "<u4", docs, at), at + 4 * docs
    heads, at = np.frombuffer(data, "<u4", 3 * n, at).reshape(3, n), at + 12 * n
    try:
        order0, at = Shares.unpacked(data[at : at + shares]), at + shares
    except zlib.error as e:
        raise ValueError("the shares are damaged") from e
    words = np.zeros((n, int(heads[1].max()) + 2 if n else 0), np.uint32)
    for i, size in enumerate(heads[1].tolist()):
        words[i, :size] = np.frombuffer(data, "<u4", size, at)
        at += 4 * size
    grid = np.zeros((n, block), np.uint32)
    if n:
        lanes, last, values = Lanes(n, order0, block, words), int(heads[0, -1]), order0.ids.astype(np.uint32)
        steps, turned = block if n > 1 else last, np.zeros((TURNED, n), np.uint32)
        for t in range(steps):
            if t == last:
                lanes.end(n - 1)
            turned[t % TURNED, : lanes.n] = lanes.step()
            if (t + 1) % TURNED == 0 or t + 1 == steps:
                a = t - t % TURNED
                grid[:, a : t + 1] = values.take(turned[: t + 1 - a]).T
    ids = grid.reshape(-1)[: int(heads[0].sum())]
    for i in range(n):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != heads[2, i]:
            raise ValueError(f"block {i} is damaged")
    return [None if k == -(1 << 63) else k for k in keys.tolist()], counts, ids


def _segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, full, held, n = TaskContext.get().partitionId(), 0, [], [], 0

    def closed(held: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([h[1] for h in held])
        data = pack([h[0] for h in held], [len(h[1]) for h in held], ids)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "segment", "n_ids", "data"])

    for b in rows:
        for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((doc, np.frombuffer(ids, "<u4")))
            n += len(held[-1][1])
            if n >= SEGMENT:
                if full:
                    yield closed(full)
                    number += 1
                full, held, n = held, [], 0
    # what is left goes with the segment before it: a step of the coder costs about as much for a few lanes as for many
    if full or held:
        yield closed(full + held)


def _ended(keys: pa.Array, all_ids: Iterator[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array([np.append(x, END_ID).astype("<u4").tobytes() for x in all_ids], pa.binary())], ["doc_id", "ids"])


def encoded(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(doc_id, ids), written: each row's ids with the end id, as little-endian unsigned 32-bit integers. Where the tokenizer is of the
    kind that packing cuts into runs, no table of words is made and nothing is joined."""
    if packing.by_runs(path):
        return packing.pieces(docs, path, WHOLE, END_ID).select("doc_id", "ids")
    return materialise(bpe.encode_with(docs, bpe.word_table(docs, path, size), path, _ended, "doc_id long, ids binary", size=size))


def write(docs: DataFrame, path: str) -> DataFrame:
    """The written segments (part, segment, n_ids, data) of docs (doc_id, text) under the tokenizer at path."""
    docs = docs.select("doc_id", "text")
    size = bpe.text_bytes(docs)
    ids = encoded(docs, path, size).repartitionByRange(max(1, -(-size // PARTITION_BYTES)), "doc_id").sortWithinPartitions("doc_id")
    return materialise(ids.mapInArrow(lean(_segments), "part int, segment int, n_ids long, data binary"))


def read(segments: DataFrame) -> DataFrame:
    """(part, segment, place, doc_id, offset, n_tokens, ids_crc32) of every document in written segments."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                docs, counts, ids = unpack(b.column(2)[r].as_py())
                ends = np.cumsum(counts.astype(np.int64))
                raw, starts = ids.astype("<u4"), ends - counts
                sums = [zlib.crc32(raw[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                same = lambda c: pa.array([b.column(c)[r].as_py()] * len(docs), pa.int32())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(docs, pa.int64()), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())], ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"])

    return segments.select("part", "segment", "data").mapInArrow(lean(documents), "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")


def index(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts ids before it."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    before = segments.select("part", "segment", "n_ids").select("part", "segment", within.alias("before")).join(parts, "part")
    return read(segments).join(before, ["part", "segment"]).select("doc_id", (F.col("before_part") + F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(write(table(spark, sf_dir, "documents"), bpe.tokenizer_path("word_bpe_49k.json")))

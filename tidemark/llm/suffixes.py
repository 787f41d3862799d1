"""Exact removal of repeated byte strings by a distributed difference-cover suffix sort.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a smaller doc_id, or before in the same
document) goes. Suffixes are ordered by their first LENGTH bytes, which is all that this needs.

1.  Sample: positions of a document whose residue modulo PERIOD lies in COVER. Any two positions have a common shift
    below PERIOD that takes both into the sample; so whatever starts two equal strings of LENGTH bytes has, at that shift,
    two sampled suffixes sharing LENGTH - PERIOD + 1 = WINDOW bytes. Fingerprints of sampled windows are sorted in
    buckets; suffixes whose fingerprint has no equal are settled and discarded. A collision only keeps one too many.
2.  Split: starts with a kept sample at most PERIOD - 1 bytes on may repeat. Equal strings have equal minimizers (the
    GRAM bytes in them with the least hash), so each run of starts with one minimizer goes, as one piece of text, to
    that minimizer's bucket. A chunk sends each distinct piece once: what it holds again is decided at once.
3.  Sort: each bucket orders the suffixes of its distinct pieces by difference cover modulo 3: triples at sampled
    positions are sorted and named, the names sorted by recursion, the remaining suffixes merged in. Then the first
    LENGTH bytes of neighbours are compared as bytes, and of equal ones the earliest start stays. Before that, suffixes
    whose fingerprint of LENGTH bytes has no equal in the bucket are discarded as in the first step.

Chunks are ranges of doc_id of about equal size. A text of LENGTH bytes or more that equals an earlier one as a whole goes as a whole:
copies are told by sha256 and sampled or split only where a task can't know them yet. Where most of the text repeats otherwise, a bucket
holds many minimizers: its pieces lie in 2**FINE parts by further bits of the minimizer's hash, which are sorted one after another.

A very common passage meets different text around it in every document, which would make its minimizers' parts large: pieces
of buckets with a part above HOT_BYTES are cut anew, ROUNDS times: the grams of all these pieces are counted, in cells by their
hash, and those of common cells give a minimizer only where there is no other. What is left then has common grams only, such as
runs of one byte: each task keeps of every string of LENGTH bytes the earliest start, and these strings go, each alone, to
buckets by their own digest.

Nulls: a null text is empty; texts under LENGTH bytes lose nothing. A null doc_id sorts first. Rows that share a doc_id are
ordered by their text; where they are more than a chunk, it is cut at the beginnings (CUT characters) of their texts. Rows
that agree in doc_id and beginning stay in one chunk. Other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import Prefixes, give_back, lean, materialise, mixed, small_batches, table, utf8

LENGTH = 100
PERIOD = 57
#: A perfect difference cover modulo 57.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
WINDOW = LENGTH - PERIOD + 1
GRAM = 16
#: Text bytes of a chunk, about; buckets of pieces for each chunk.
CHUNK_BYTES = 16 << 20
BUCKETS = 4
#: Parts of a bucket, as a power of two: where all text repeats, a bucket holds 13 MB of pieces, as they overlap.
FINE = 4
#: Bytes of pieces of a part above which a bucket is cut anew: ROUNDS times by grams, then by whole strings; parts are sorted
#: together up to a quarter of it, as sorts in a core's cache are quicker.
HOT_BYTES = 4 << 20
ROUNDS = 3
#: Cells of grams that are counted together.
CELLS = 1 << 14
#: Strings of LENGTH bytes that a task holds at a time in the last of these cuts.
HELD = 200_000
#: Characters of a text that tell chunks of one doc_id.
CUT = 256
#: Text bytes that a task works on at a time.
PART = 1 << 20
MEASURES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
_SETS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("many", pa.bool_()), ("names", pa.binary())])
_FIRST = -(1 << 63)
_TOP = np.uint64(1 << 63)


def squeezed(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values, as differences by byte planes."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def expanded(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(kind), dtype=kind)


def joined(columns: list[np.ndarray], blob: bytes = b"") -> bytes:
    """Columns of 32-bit numbers of one length, and bytes after them."""
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(columns[0])).tobytes() + b"".join(c.astype(np.uint32).tobytes() for c in columns) + blob)


def parted(data: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at = 4 + 4 * n * columns
    return [c.astype(np.int64) for c in np.frombuffer(raw, np.uint32, n * columns, 4).reshape(columns, n)], raw[at:]


def steps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each start, so many as its size, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about PART bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
        yield a, z
        a = z


def sampled(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions in documents end to end at the cuts, and how many each has."""
    room = np.maximum(np.diff(cut) - WINDOW + 1, 0)
    cover = np.array(COVER)
    n = room // PERIOD * len(cover) + np.searchsorted(cover, room % PERIOD)
    k = steps(np.zeros(len(n), np.int64), n)
    return k // len(cover) * PERIOD + cover[k % len(cover)] + np.repeat(cut[:-1], n), n


def candidates(cut: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first start, past the last, document) of starts with a kept sample (found, in order) at most PERIOD - 1 bytes on."""
    doc = np.searchsorted(cut, found, "right") - 1
    new = np.flatnonzero(np.concatenate(([True], (np.diff(found) > PERIOD) | (np.diff(doc) > 0)))) if len(found) else np.zeros(0, np.int64)
    doc = doc[new]
    last = found[np.append(new[1:] - 1, len(found) - 1)] if len(new) else new
    first, past = np.maximum(found[new] - PERIOD + 1, cut[doc]), np.minimum(last + 1, cut[doc + 1] - LENGTH + 1)
    some = past > first
    return first[some], past[some], doc[some]


def pieces(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one minimizer, given the hashes of all grams of runs of so many starts each.

    A run of n starts has n + LENGTH - GRAM grams. Returns (run, first start in the run, minimizer) of each piece, in order.
    """
    wide = LENGTH - GRAM + 1
    low, span = hashes, 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    at = np.cumsum(sizes + wide - 1) - (sizes + wide - 1)
    low, run, first = low[steps(at, sizes)], np.repeat(np.arange(len(sizes)), sizes), steps(np.zeros(len(sizes), np.int64), sizes)
    new = np.flatnonzero((first == 0) | np.concatenate(([True], low[1:] != low[:-1])))
    return run[new], first[new], low[new]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each minimizer, of 2**buckets; minimizers are small, so they are spread first; the top bit doesn't count."""
    return (mixed(hashes << np.uint64(1)) >> np.uint64(64 - buckets)).astype(np.int64)


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of s (numbers from 0) in the order of their first depth numbers at least.

    Suffixes that agree so far have neighbouring ranks in any order. Beyond its end s counts as smaller than any number.
    """
    n = len(s)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    t[:n] += 1
    if n < 3:
        rank = np.empty(n, np.int64)
        rank[np.lexsort((t[1 : n + 1], t[:n]))] = np.arange(n)
        return rank
    bits = int(t.max()).bit_length()
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    at = np.concatenate((one, two))

    def triple(x: np.ndarray, y: np.ndarray, z: np.ndarray, wide: int) -> np.ndarray:
        if 2 * bits + wide > 63:
            return np.unique(x << bits | y, return_inverse=True)[1] << wide | z
        return (x << bits | y) << wide | z

    key = triple(t[at], t[at + 1], t[at + 2], bits)
    order = np.argsort(key)
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
    if depth > 3 and names[order[-1]] + 1 < len(at):
        inner = suffix_ranks(np.concatenate((names[: len(one)] + 1, [0], names[len(one) :] + 1)), -(-depth // 3))
        names = np.concatenate((inner[: len(one)], inner[len(one) + 1 :]))
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[at] = names + 1
    high = int(rank.max()).bit_length()
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] << high | rank[zero + 1])]
    rest = at[order]
    first, second = rest[rest % 3 == 1], rest[rest % 3 == 2]
    below = np.searchsorted(t[first] << high | rank[first + 1], t[zero] << high | rank[zero + 1])
    both = np.concatenate((second, zero))
    both = triple(t[both], t[both + 1], rank[both + 2], high)
    below += np.searchsorted(both[: len(second)], both[len(second) :])
    below = np.maximum.accumulate(below)
    out = np.empty(n, np.int64)
    out[zero] = below + np.arange(len(zero))
    out[rest] = np.arange(len(rest)) + np.searchsorted(below, np.arange(len(rest)), "right")
    return out


def equal_starts(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the starts' suffixes, and where in it a new string of LENGTH bytes begins."""
    order = np.argsort(suffix_ranks(text, LENGTH)[starts])
    starts = starts[order]
    words = np.zeros(max(0, len(text) - 7), np.uint64)
    for k in range(8):
        words |= text[k : len(text) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(0, len(starts) - 1), bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        w = words[starts + k]
        same &= w[1:] == w[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same))) if len(starts) else np.zeros(0, np.int64)


def _chunk_of(ids: pa.Array, texts: pa.Array, bounds: np.ndarray, cuts: dict[int, list[bytes]]) -> np.ndarray:
    """How many bounds are smaller: each is an id's end or, as often as cuts has beginnings of its texts, one of those."""
    ids = ids.fill_null(_FIRST).to_numpy()
    chunks = np.searchsorted(bounds, ids, "left")
    for i in np.flatnonzero(np.isin(ids, list(cuts))).tolist() if cuts else ():
        chunks[i] += bisect_left(cuts[int(ids[i])], (texts[i].as_py() or "").encode())
    return chunks


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """The sha256 of each text that has a string of LENGTH bytes."""
    edges = offsets.tolist()
    return [hashlib.sha256(data[a:z]).digest() if z - a >= LENGTH else None for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _only(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of some documents, end to end."""
    if len(docs) == len(offsets) - 1:
        return data, offsets
    begin, past = offsets[docs], offsets[docs + 1]
    texts = [data[a:z] for a, z in zip(begin.tolist(), past.tolist(), strict=True)]
    return np.concatenate(texts) if texts else data[:0], np.concatenate(([0], np.cumsum(past - begin)))


def _sample_sets(bounds, bits: int, cuts=None) -> Callable:
    """(bucket, chunk, many, names): fingerprints of sampled windows as sorted sets, those that a task met again apart; digests of
    whole texts under buckets below 0. A text that the task has sampled in this chunk or an earlier one isn't sampled again."""
    wide = max(0, bits - 4)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        least: dict[bytes, int] = {}
        met: set[tuple[int, bytes]] = set()
        n = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            whole: dict[tuple[int, int], list[bytes]] = {}
            for chunk, digest in met:
                whole.setdefault((-1 - (int.from_bytes(digest[:4], "little") >> (32 - wide)), chunk), []).append(digest)
            if whole:
                yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": c, "many": False, "names": b"".join(x)} for (b, c), x in sorted(whole.items())], _SETS)
            least.clear()
            met.clear()
            for chunk, own in sorted(held.items()):
                names, times = np.unique(np.concatenate(own), return_counts=True)
                cut = np.searchsorted(names >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
                rows = []
                for bucket, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    for many in (False, True) if z > a else ():
                        some = names[a:z][(times[a:z] > 1) == many].astype(np.uint32)
                        if len(some):
                            rows.append((bucket, chunk, many, squeezed(some)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SETS.types, strict=True)], schema=_SETS)
            held.clear()

        for b in batches:
            chunks = _chunk_of(b.column(0), b.column(1), bounds.value, cuts.value if cuts else {})
            data, offsets = utf8(b.column(1))
            fresh = []
            for i, (chunk, digest) in enumerate(zip(chunks.tolist(), _digests(data, offsets), strict=True)):
                if digest is not None:
                    met.add((chunk, digest))
                    if least.get(digest, chunk + 1) <= chunk:
                        continue
                    least[digest] = chunk
                fresh.append(i)
            fresh = np.array(fresh, np.int64)
            data, offsets = _only(data, offsets, fresh)
            chunks = chunks[fresh]
            for a, z in parts(offsets):
                at, count = sampled(offsets[a : z + 1] - offsets[a])
                names = Prefixes.of_bytes(data[offsets[a] : offsets[z]]).slices(at, at + WINDOW) >> np.uint64(32 - bits)
                of = np.repeat(chunks[a:z], count)
                for chunk in np.unique(chunks[a:z]).tolist():
                    held.setdefault(chunk, []).append(names[of == chunk])
                n += len(names)
                if n > 4_000_000:
                    yield from flushed()
                    n = 0
        yield from flushed()

    return made


def _copies(sets: pa.Table) -> pa.Table:
    """Of each chunk the digests of its texts that an earlier chunk has."""
    least: dict[bytes, int] = {}
    own: dict[int, list[bytes]] = {}
    for chunk, names in sorted(zip(sets.column("chunk").to_pylist(), sets.column("names").to_pylist(), strict=True)):
        for digest in (names[i : i + 32] for i in range(0, len(names), 32)):
            if least.setdefault(digest, chunk) < chunk:
                own.setdefault(chunk, []).append(digest)
    bucket = sets.column("bucket")[0].as_py()
    return pa.table({"chunk": pa.array(own, pa.int64()), "bucket": pa.array([bucket] * len(own), pa.int64()), "names": pa.array([b"".join(sorted(set(x))) for x in own.values()], pa.binary())})


def _kept_samples(sets: pa.Table) -> pa.Table:
    """Of each chunk the fingerprints of its samples that any chunk has again; under buckets below 0 its copies."""
    if sets.column("bucket")[0].as_py() < 0:
        return _copies(sets)
    lists = [expanded(x.as_py(), np.uint32) for x in sets.column("names")]
    sizes = [len(p) for p in lists]
    names, chunk, many = np.concatenate(lists), np.repeat(sets.column("chunk").to_numpy(), sizes), np.repeat(sets.column("many").to_numpy(), sizes)
    order = np.lexsort((chunk, names))
    names, chunk, many = names[order], chunk[order], many[order]
    again = np.concatenate(([False], names[1:] == names[:-1]))
    again |= np.append(again[1:], False) | many
    names, chunk = names[again], chunk[again]
    order = np.argsort(chunk, kind="stable")
    names, chunk = names[order], chunk[order]
    own, at = np.unique(chunk, return_index=True)
    bucket = sets.column("bucket")[0].as_py()
    packed = [squeezed(np.unique(x)) for x in np.split(names, at[1:])] if len(own) else []
    return pa.table({"chunk": pa.array(own, pa.int64()), "bucket": pa.array([bucket] * len(own), pa.int64()), "names": pa.array(packed, pa.binary())})


def _bundled(bounds, cuts=None) -> Callable:
    """Rows as compressed bundles, each of one chunk."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        n = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for chunk, own in sorted(held.items()):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, own[0].schema) as out:
                    out.write_table(pa.Table.from_batches(own).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue())], pa.binary())], ["chunk", "rows"])
            held.clear()

        for b in batches:
            chunks = _chunk_of(b.column(0), b.column(1), bounds.value, cuts.value if cuts else {})
            for chunk in np.unique(chunks).tolist():
                held.setdefault(chunk, []).append(b.take(pa.array(np.flatnonzero(chunks == chunk))))
            n += b.nbytes
            if n > 32 << 20:
                yield from flushed()
                n = 0
        yield from flushed()

    return made


def _unbundled(bundles: pa.Table) -> pa.Table:
    """The rows of a chunk in order of doc_id and text."""
    got = pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(r.as_py())).read_all() for r in bundles.column("rows")])
    ids = got.column(0).fill_null(_FIRST).to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        order = pc.sort_indices(pa.table({"i": ids, "t": got.column("text").fill_null("")}), [("i", "ascending"), ("t", "ascending")]).to_numpy()
    elif (order == np.arange(len(order))).all():
        return got.combine_chunks()
    return got.take(pa.array(order)).combine_chunks()


def _column(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("text")
    return utf8(column.chunk(0) if column.num_chunks == 1 else column.combine_chunks())


def _rows(found: list[tuple]) -> pa.Table:
    bucket, chunk, size, data = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "size": pa.array(size, pa.int64()), "data": pa.array(data, pa.binary())})


def _bucketed(chunk: int, part: np.ndarray, doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> list[tuple]:
    """A row (bucket, chunk, size, data) for the pieces of each bucket, given their parts; its size is that of its largest part."""
    order = np.argsort(part, kind="stable")
    part, doc, start = part[order], doc[order], start[order]
    bucket, part = part >> FINE, part & ((1 << FINE) - 1)
    sizes = np.array([len(x) for x in texts], np.int64)[order]
    edges = [*np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist(), len(order)] if len(order) else [0]
    order = order.tolist()
    return [(int(bucket[a]), chunk, int(np.bincount(part[a:z], sizes[a:z]).max()), joined([doc[a:z], start[a:z], sizes[a:z], part[a:z]], b"".join([texts[i] for i in order[a:z]]))) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _split(bits: int, buckets: int) -> Callable:
    """A chunk's distinct pieces by bucket; under bucket -1 the starts of those that it had before."""

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # of the chunk before
        if not left.num_rows:
            return _rows([])
        kept = [np.uint64(r["bucket"]) << np.uint64(32) | expanded(r["names"], np.uint32).astype(np.uint64) for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]) if r["bucket"] >= 0]
        kept = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
        chunk = left.column("chunk")[0].as_py()
        data, offsets = _column(_unbundled(left))
        known = {r["names"][i : i + 32] for r in right.to_pylist() if r["bucket"] < 0 for i in range(0, len(r["names"]), 32)}
        copy = np.zeros(len(offsets) - 1, bool)
        for i, digest in enumerate(_digests(data, offsets)):
            if digest is not None:
                copy[i] = digest in known
                known.add(digest)
        own, whole = np.flatnonzero(~copy), np.flatnonzero(copy)
        again = [np.stack((whole, np.zeros(len(whole), np.int64), np.diff(offsets)[whole] - LENGTH + 1))]
        data, offsets = _only(data, offsets, own)
        seen: set[bytes] = set()
        new = []
        for a, z in parts(offsets) if len(kept) else ():
            text, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
            at, _ = sampled(cut)
            if not len(at):
                continue
            hashes = Prefixes.of_bytes(text)
            names = hashes.slices(at, at + WINDOW) >> np.uint64(32 - bits)
            first, past, doc = candidates(cut, at[kept[np.minimum(np.searchsorted(kept, names), len(kept) - 1)] == names])
            if not len(first):
                continue
            grams = steps(first, past - first + LENGTH - GRAM)
            run, start, low = pieces(hashes.slices(grams, grams + GRAM), past - first)
            ends = np.append(start[1:], 0)
            ends[np.append(run[1:] != run[:-1], True)] = past - first  # the last piece of a run ends with it
            begin, count = first[run] + start, ends - start
            raw, fresh = text.tobytes(), np.zeros(len(run), bool)
            texts = []
            for i, (s, n) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
                piece = raw[s : s + n + LENGTH - 1]
                if piece not in seen:
                    seen.add(piece)
                    fresh[i] = True
                    texts.append(piece)
            place, where = own[doc[run] + a], begin - cut[doc[run]]
            new.append((bucket_of(low, buckets + FINE)[fresh], place[fresh], where[fresh], texts))
            again.append(np.stack((place, where, count))[:, ~fresh])
        out = _bucketed(chunk, *(np.concatenate([x[k] for x in new]) for k in range(3)), [t for x in new for t in x[3]]) if new else []
        return _rows([*out, (-1, chunk, 0, joined(list(np.concatenate(again, 1))))])

    return made


def _slices(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Documents, starts, sizes and bytes of a row's pieces, of about PART bytes at a time."""
    (doc, start, sizes, _), raw = parted(data, 4)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for a, z in parts(ends):
        yield doc[a:z], start[a:z], sizes[a:z], raw[ends[a] : ends[z]]


def _grams(sizes: np.ndarray, raw: bytes, turn: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of pieces end to end, of another order in each turn, and their cells of 2**bits."""
    grams = steps(np.cumsum(sizes) - sizes, sizes - GRAM + 1)
    h = Prefixes.of_bytes(np.frombuffer(raw, np.uint8)).slices(grams, grams + GRAM)
    for _ in range(turn):
        h = mixed(h + np.uint64(1))
    return h, bucket_of(h, bits)


def _gram_counts(turn: int, bits: int) -> Callable:
    """(range, data): how many grams of the pieces lie in each cell, by ranges of CELLS."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            for packed in b.column("data"):
                for _, _, sizes, raw in _slices(packed.as_py()):
                    np.add.at(counts, _grams(sizes, raw, turn, bits)[1], 1)
        some = np.flatnonzero(counts)
        if len(some):
            ranges, first = np.unique(some // CELLS, return_index=True)
            data = [joined([x, counts[x]]) for x in np.split(some, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(data, pa.binary())], ["range", "data"])

    return made


def _common(limit: int) -> Callable:
    """The cells of a range with more than limit grams."""

    def made(rows: pa.Table) -> pa.Table:
        low, counts = rows.column("range")[0].as_py() * CELLS, np.zeros(CELLS, np.int64)
        for packed in rows.column("data"):
            cells, n = parted(packed.as_py(), 2)[0]
            counts[cells - low] += n
        found = np.flatnonzero(counts > limit) + low
        return pa.table({"cells": pa.array([squeezed(found.astype(np.uint32))] if len(found) else [], pa.binary())})

    return made


def common_grams(hot: DataFrame, turn: int, hot_bytes: int) -> tuple[int, np.ndarray]:
    """The cells (of 2**bits) whose grams would fill a quarter of a part's bytes each, if they were minimizers."""
    limit = max(1, hot_bytes // (4 * LENGTH))
    size = hot.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("b")).first().b
    bits = min(24, max(12, (32 * size // limit).bit_length()))  # an eighth of the limit in a cell on average, or less
    rows = hot.select("data").mapInArrow(lean(_gram_counts(turn, bits)), "range long, data binary").groupBy("range").applyInArrow(_common(limit), "cells binary").collect()
    return bits, np.sort(np.concatenate([np.zeros(0, np.uint32), *(expanded(r.cells, np.uint32) for r in rows)]))


def _cut_anew(turn: int, bits: int, common, buckets: int) -> Callable:
    """Pieces by the minimizers among their grams outside the common cells, if there are any."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = np.zeros(1 << bits, bool)
        lift[common.value] = True
        for b in batches:
            for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("data"), strict=True):
                new = []
                for doc, start, sizes, raw in _slices(packed.as_py()):
                    at = np.cumsum(sizes) - sizes
                    h, cells = _grams(sizes, raw, turn, bits)
                    run, first, low = pieces(np.where(lift[cells], h | _TOP, h & ~_TOP), sizes - LENGTH + 1)
                    ends = np.append(first[1:], 0)
                    ends[np.append(run[1:] != run[:-1], True)] = sizes - LENGTH + 1
                    begin = (at[run] + first).tolist()
                    texts = [raw[s : s + n + LENGTH - 1] for s, n in zip(begin, (ends - first).tolist(), strict=True)]
                    new.append((bucket_of(low, buckets + FINE), doc[run], start[run] + first, texts))
                yield from _rows(_bucketed(chunk, *(np.concatenate([x[k] for x in new]) for k in range(3)), [t for x in new for t in x[3]])).to_batches()

    return made


def _opened_parts(chunk: int, data: bytes) -> Iterator[tuple[int, tuple[int, int, int, bytes]]]:
    (doc, start, sizes, part), raw = parted(data, 4)
    at = 0
    for d, s, n, p in zip(doc.tolist(), start.tolist(), sizes.tolist(), part.tolist(), strict=True):
        yield p, (chunk, d, s, raw[at : at + n])
        at += n


def _opened(chunk: int, data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    return (piece for _, piece in _opened_parts(chunk, data))


def _later(found: Iterable[tuple[int, int, int, bytes]]) -> np.ndarray:
    """Among pieces (chunk, document, start, bytes) the starts (chunk, document, start, count) whose strings start earlier in others."""
    place: dict[bytes, int] = {}
    best, gone = [], []
    for chunk, d, s, piece in found:
        own = place.setdefault(piece, len(place))
        if own == len(best):
            best.append((chunk, d, s))
        elif best[own] > (chunk, d, s):
            gone.append((*best[own], len(piece) - LENGTH + 1))
            best[own] = (chunk, d, s)
        else:
            gone.append((chunk, d, s, len(piece) - LENGTH + 1))
    text = np.frombuffer(b"".join(place), np.uint8)
    sizes = np.fromiter(map(len, place), np.int64, len(place))
    counts, at = sizes - LENGTH + 1, np.cumsum(sizes) - sizes
    starts = steps(at, counts)
    names = Prefixes.of_bytes(text).slices(starts, starts + LENGTH)
    order = np.argsort(names)
    equal = names[order[1:]] == names[order[:-1]]
    repeated = np.zeros(len(starts), bool)
    repeated[order] = np.append(equal, False) | np.append(False, equal)
    chunk, doc, start = np.array(best, np.int64).T
    doc_rank = np.unique(np.stack((chunk, doc)), axis=1, return_inverse=True)[1].reshape(-1)
    key = (np.repeat(doc_rank << 32, counts) + steps(start, counts))[repeated]
    starts = starts[repeated]  # the others' strings have no equal: discarded
    first = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
    runs = np.diff(np.append(first, len(starts)))
    wide = runs + LENGTH - 1
    order, new = equal_starts(text[steps(starts[first], wide)], steps(np.cumsum(wide) - wide, runs))
    starts, key = starts[order], key[order]
    least = np.repeat(np.minimum.reduceat(key, new), np.diff(np.append(new, len(key)))) if len(key) else key
    again = np.zeros(len(text) + 1, bool)
    again[starts[key > least]] = True
    again = np.flatnonzero(again)
    piece = np.searchsorted(at, again, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (np.diff(again) > 1) | (np.diff(piece) > 0)))) if len(again) else np.zeros(0, np.int64)
    n, piece, begin = np.diff(np.append(first, len(again))), piece[first], again[first]
    return np.concatenate((np.stack((chunk[piece], doc[piece], start[piece] + begin - at[piece], n), 1), np.array(gone, np.int64).reshape(-1, 4)))


def _decided(rows: pa.Table) -> pa.Table:
    """(chunk, data) of a bucket: the starts (document, start, count) whose strings start earlier elsewhere."""
    give_back()  # of the bucket before
    own: list[list[tuple[int, int, int, bytes]]] = [[] for _ in range(1 << FINE)]
    for row in sorted(zip(rows.column("chunk").to_pylist(), rows.column("data").to_pylist(), strict=True)):
        for part, piece in _opened_parts(*row):
            own[part].append(piece)
    turns, size = [[]], 0
    for part in own:
        n = sum(len(piece[3]) for piece in part)
        if n and size and size + n > HOT_BYTES // 4:
            turns.append([])
            size = 0
        turns[-1] += part
        size += n
    found = []
    while turns:
        found.append(_later(turns.pop()))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    chunks, first = np.unique(found[:, 0], return_index=True)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "data": pa.array([joined(list(x[:, 1:].T)) for x in np.split(found, first[1:])] if len(chunks) else [], pa.binary())})


def _by_string(buckets: int) -> Callable:
    """Each string of LENGTH bytes in the pieces alone, with its earliest start in the task, by its digest; under bucket -1 the other starts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int]] = {}
        gone: list[tuple[int, int, int]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            out = []
            for chunk in sorted({p[0] for p in gone}):
                doc, start = np.array([p[1:] for p in gone if p[0] == chunk], np.int64).T
                out.append((-1, chunk, 0, joined([doc, start, np.ones(len(doc), np.int64)])))
            own: dict[int, list[tuple[int, int, bytes]]] = {}
            for string, (chunk, d, s) in held.items():
                own.setdefault(chunk, []).append((d, s, string))
            for chunk, rows in sorted(own.items()):
                doc, start, texts = zip(*rows, strict=True)
                digests = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts], np.uint64)
                out += _bucketed(chunk, bucket_of(digests, buckets + FINE), np.array(doc, np.int64), np.array(start, np.int64), list(texts))
            held.clear()
            gone.clear()
            yield from _rows(out).to_batches()

        def kept(part: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            later = _later(part)
            begin = np.array([(d << 32) + s for _, d, s, _ in part], np.int64)
            counts = np.array([len(p[3]) - LENGTH + 1 for p in part], np.int64)
            starts = steps(begin, counts)
            left = np.flatnonzero(~np.isin(starts, steps((later[:, 1] << 32) + later[:, 2], later[:, 3])))
            of = np.repeat(np.arange(len(part)), counts)[left]
            chunk = part[0][0]
            if len(later):
                yield from _rows([(-1, chunk, 0, joined(list(later[:, 1:].T)))]).to_batches()
            for i, k in zip(of.tolist(), (starts[left] - begin[of]).tolist(), strict=True):
                _, d, s, piece = part[i]
                string, mine = piece[k : k + LENGTH], (chunk, d, s + k)
                first = held.setdefault(string, mine)
                if first != mine:
                    held[string] = min(first, mine)
                    gone.append(max(first, mine))
            if len(held) + len(gone) > HELD:
                yield from flushed()

        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                part, size = [], 0
                for _, d, s, piece in _opened(chunk, data):
                    for a in range(0, len(piece) - LENGTH + 1, PART):  # long pieces in parts that share LENGTH - 1 bytes
                        part.append((chunk, d, s + a, piece[a : a + PART + LENGTH - 1]))
                        size += len(part[-1][3])
                        if size >= PART:
                            yield from kept(part)
                            part, size = [], 0
                if part:
                    yield from kept(part)
        yield from flushed()

    return made


def spans(offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (document, first, past) that strings of LENGTH bytes at so many starts each cover."""
    begin = offsets[doc] + start
    order = np.argsort(begin, kind="stable")
    begin, doc, past = begin[order], doc[order], (begin + count + LENGTH - 1)[order]
    reach = np.maximum.accumulate(past) if len(past) else past
    new = np.flatnonzero(np.concatenate(([True], (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))) if len(past) else np.zeros(0, np.int64)
    return doc[new], begin[new] - offsets[doc[new]], (reach[np.append(new[1:] - 1, len(reach) - 1)] if len(new) else reach) - offsets[doc[new]]


def _removed(fields: pa.Schema, whole: bool, measures: tuple[str, ...]) -> Callable:
    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # of the chunk before
        extra = [pa.field(n, t) for n, t in zip(measures, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        schema = pa.schema([f for f in fields if whole or f.name == "doc_id"] + extra)
        if not left.num_rows:
            return schema.empty_table()
        rows = _unbundled(left)
        data, offsets = _column(rows)
        found = [parted(x.as_py(), 3)[0] for x in right.column("data")]
        doc, first, past = spans(offsets, *(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)))
        cuts: dict[int, list[tuple[int, int]]] = {}
        for d, a, z in zip(doc.tolist(), first.tolist(), past.tolist(), strict=True):
            cuts.setdefault(d, []).append((a, z))
        out, new = [], {}
        for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            raw = data[a:z].tobytes()
            if i in cuts:
                last, kept = 0, []
                for x, y in cuts[i]:
                    kept.append(raw[last:x])
                    last = y
                new[i] = b"".join([*kept, raw[last:]])
            rest = new.get(i, raw)
            out.append((len(raw), len(raw) - len(rest), len(cuts.get(i, ())), hashlib.sha256(rest).hexdigest()))
        columns = {f.name: rows.column(f.name) for f in fields if whole or f.name == "doc_id"}
        if whole and new:
            # a cut may fall within a character: its stray bytes go as well
            columns["text"] = pa.array([new[i].decode("utf-8", "ignore") if i in new else t.as_py() for i, t in enumerate(rows.column("text"))], pa.string())
        return pa.table(columns | {f.name: pa.array([o[i] for o in out], f.type) for i, f in enumerate(extra)}, schema=schema)

    return made


def chunk_bounds(docs: DataFrame, chunks: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, dict[int, list[bytes]]]:
    """About chunks bounds that cut docs into ranges of about equal bytes: doc_ids, coarse parts first, then each part by itself;
    and of ids with more text than that the beginnings of texts to cut them at, each of which is a bound as well."""
    if chunks == 1:
        return np.zeros(0, np.int64), {}
    units = F.sequence(F.lit(0), F.coalesce((F.octet_length("text") / 4096).cast("int"), F.lit(0)))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), "text")
    weighted = materialise(keyed.select("doc_id", F.explode(units).alias("unit")).select("doc_id"))
    coarse = int(np.ceil(chunks**0.5))
    fine = -(-chunks // coarse)
    quantiles = lambda n: F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")
    outer = np.array(weighted.agg(quantiles(coarse)).first().q or [] if coarse > 1 else [], np.int64)
    found = [outer]
    outer = np.unique(outer)
    if fine > 1:

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(outer, b.column(0).to_numpy(), "left")), b.column(0)], ["part", "doc_id"])

        inner = weighted.mapInArrow(part, "part long, doc_id long").groupBy("part").agg(quantiles(fine)).collect()
        found += [np.array(r.q, np.int64) for r in inner]
    bounds = np.unique(np.concatenate(found))
    # an id at two bounds of one kind is more than a chunk
    large = np.unique(np.concatenate([q[1:][q[1:] == q[:-1]] for q in found]))
    if not len(large):
        return bounds, {}
    own = keyed.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in large.tolist()], "doc_id long")), "doc_id")
    n = -(-own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b // chunk_bytes)
    own = own.select("doc_id", F.coalesce(F.left("text", F.lit(CUT)), F.lit("")).alias("begin"), F.explode(units)).repartitionByRange(max(n, 1), "doc_id", "begin")
    cuts: dict[int, set[bytes]] = {}
    for r in own.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "begin")).alias("x")).collect():
        cuts.setdefault(r.x.doc_id, set()).add(r.x.begin.encode())
    bounds = np.sort(np.concatenate([bounds, *(np.full(len(c), i, np.int64) for i, c in cuts.items())]))
    return bounds, {i: sorted(c) for i, c in cuts.items()}


def deduplicated(docs: DataFrame, whole: bool = True, chunk_bytes: int = CHUNK_BYTES, hot_bytes: int = HOT_BYTES, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """docs (doc_id, text, ...) with the remaining text and the measures (bytes, removed bytes, removed runs, sha256 of the rest); or doc_id and those."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text", *measures)))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    chunks = max(1, -(-size // chunk_bytes))
    bits = min(31, (chunks - 1).bit_length())
    buckets = min(40, (BUCKETS * chunks - 1).bit_length())
    bounds, cuts = map(spark.sparkContext.broadcast, chunk_bounds(docs, chunks, chunk_bytes))

    only = docs.select("doc_id", "text")
    sets = only.mapInArrow(lean(_sample_sets(bounds, bits, cuts)), "bucket long, chunk long, many boolean, names binary")
    kept = sets.groupBy("bucket").applyInArrow(_kept_samples, "chunk long, bucket long, names binary")
    bundled = only.mapInArrow(lean(_bundled(bounds, cuts)), "chunk long, rows binary")
    schema = "bucket long, chunk long, size long, data binary"
    split = materialise(bundled.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(_split(bits, buckets), schema))
    before, settled, open_ = split.where("bucket = -1").select("chunk", "data"), [], split.where("bucket >= 0")
    for k in range(ROUNDS + 1):
        found = [r.bucket for r in open_.groupBy("bucket").agg(F.sum("size").alias("size")).where(F.col("size") > hot_bytes).select("bucket").collect()]
        if not found:
            break
        known = spark.createDataFrame([(x,) for x in found], "bucket long")
        settled.append(open_.join(F.broadcast(known), "bucket", "left_anti"))
        hot = open_.join(F.broadcast(known), "bucket", "left_semi").select("bucket", "chunk", "size", "data")
        if k < ROUNDS:
            bits, common = common_grams(hot, k + 1, hot_bytes)
            cut = _cut_anew(k + 1, bits, spark.sparkContext.broadcast(common), buckets)
        else:
            cut = _by_string(buckets)
        open_ = materialise(hot.mapInArrow(lean(cut), schema))
    else:
        before = before.unionByName(open_.where("bucket = -1").select("chunk", "data"))
        open_ = open_.where("bucket >= 0")
    decided = before
    for each in [*settled, open_]:
        decided = decided.unionByName(each.groupBy("bucket").applyInArrow(_decided, "chunk long, data binary"))
    fields = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in docs.schema])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if whole or f.name == "doc_id"] + [f"`{n}` {t}" for n, t in zip(measures, ("long", "long", "long", "string"), strict=True)])
    bundles = docs.mapInArrow(lean(_bundled(bounds, cuts)), "chunk long, rows binary") if whole else bundled
    return bundles.groupBy("chunk").cogroup(decided.groupBy("chunk")).applyInArrow(_removed(fields, whole, measures), schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=False)

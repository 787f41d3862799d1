"""BPE encoding and decoding over a table of distinct words.

1.  Split: Spark tasks cut each text into the tokenizer's words (numpy over code points, by the tokenizer's own pattern)
    and pass on each distinct word once, packed by ranges of a 64-bit hash.
2.  Encode: each distinct word of the corpus is encoded once, by the tokenizers library; the table is written.
3.  Join: words find their ids by hash, in order of position. Of the words that several tasks met, the rows of those that
    the most met travel to the tasks, at most HEAD_BYTES of them. All others are joined by shuffle: no text is shuffled: the ids
    found so far are written with the places and hashes of the gaps, bucketed by chunks of consecutive documents, and
    each chunk meets just its own missing words' rows in a cogroup, which fills the gaps.
4.  Decode: a join of the ids with the vocabulary's id-to-piece table, pieces put together in order.

Words may be encoded by themselves because the pre-tokenizer never lets a merge cross them. The strings of added tokens
are cut out first, as the library does. Where two words have one hash the table has no ids, and each task encodes those
words itself. Which characters are letters, numbers or white space is read off the library.

Nulls: a null text encodes as an empty one, to no ids. Repeated rows are each encoded; extra columns of docs are ignored
by encoded(); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Prefixes, lean, materialise, materialise_buckets, mixed, small_batches, table, utf8

#: Of the words in every task's memory: 12 bytes a word and two or four an id.
HEAD_BYTES = 32 << 20
#: Words that more tasks met than this count alike when the head is chosen.
MOST_MET = 1000
#: Text bytes of a chunk of documents whose gaps are filled together, about.
CHUNK_BYTES = 8 << 20
#: Text bytes of a bucket of such chunks, about, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 20_000
#: Distinct words that a task gathers before it passes them on.
REMEMBERED = 1 << 19
#: Code points of words that are compared at a time.
COMPARED = 1 << 20
#: Text bytes for each partition of distinct words, about; packed bytes that such a partition merges at a time, and words it encodes at a time.
WORDS_BYTES, MERGED_BYTES, ENCODED_WORDS = 16 << 20, 8 << 20, 5000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other, as the library sees it."""
    from tokenizers import Regex, normalizers

    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    out = np.full(sys.maxunicode + 1, 3, np.uint8)
    for kind, pattern in enumerate((r"[^\s]+", r"[^\p{L}]+", r"[^\p{N}]+")):
        out[np.frombuffer(normalizers.Replace(Regex(pattern), "").normalize_str(every).encode("utf-32-le"), np.uint32)] = kind
    return out


@functools.cache
def unknown() -> np.ndarray:
    """Of each code point, whether Python's tables don't have it."""
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.cache
def library(path: str):
    """The library's tokenizer without truncation and padding, one a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: What may follow an apostrophe to make a word of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Splitter:
    """Words of a text under one of two patterns: spaced (a space joins the word after it, runs of numbers stay whole)
    or not (white space is dropped, each number stands alone, texts are normalised first)."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.path = path
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_added = re.compile("|".join(map(re.escape, self.added)))
        #: Of ids in word tables.
        self.kind = np.dtype("<u2" if max(max(spec["model"]["vocab"].values()), *self.added.values()) < 1 << 16 else "<u4")

    def pieces(self, text: str) -> Iterator[str | int]:
        """The text between added tokens, and those tokens' ids."""
        at = 0
        if any(t in text for t in self.added):
            for found in self.any_added.finditer(text):
                yield text[at : found.start()]
                yield self.added[found.group()]
                at = found.end()
        yield text[at:]

    def normal(self, text: str) -> str:
        if self.spaced or not text:
            return text
        if text.isascii():
            return text.lower()
        if unknown()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return library(self.path).normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of a normalised text."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cls = classes()[cp]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        space = cls == 0
        if self.spaced:
            after = np.flatnonzero(space[:-1] & ~space[1:])  # the last of each run of white space before a word
            blank = cp[after] == 0x20
            start[after] = True
            start[after[blank] + 1] = False
        else:
            start |= cls == 2
        quote = np.flatnonzero((cp[:-1] == 0x27) & start[:-1]) if n > 1 else ()
        for i in quote.tolist() if len(quote) else ():
            rest = text[i + 1 : i + 3]
            size = 2 if rest in ENDINGS else 1 if rest[:1] in ENDINGS else 0
            if size:
                start[i + 1] = False
                if i + 1 + size < n:
                    start[i + 1 + size] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if not self.spaced:
            kept = ~space[starts]
            starts, ends = starts[kept], ends[kept]
        return starts, ends, word_hashes(cp, starts, ends)


def _docs(texts: Iterator[str | None], split: Splitter) -> Iterator[list]:
    """Of each text: normalised pieces with their words, or ids of added tokens."""
    for t in texts:
        out = []
        for p in split.pieces(t or ""):
            if isinstance(p, str):
                p = split.normal(p)
                out.append((p, *split.words(p)))
            else:
                out.append(p)
        yield out


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words given as slices of code points."""
    return Prefixes(mixed(cp.astype(np.uint64) + np.uint64(0x9E37))).words(starts, ends, lambda a, z: cp[a:z].tobytes())


def _packed(h: np.ndarray, words: pa.Array, buckets: int) -> pa.RecordBatch:
    """(bucket, words) of words in the order of their hashes: a row a bucket, the lengths and the bytes of its words compressed.
    Hashes aren't sent, since the words give them again."""
    data, offsets = utf8(words)
    of = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(h)) if len(h) else np.zeros(1, np.int64)
    pack = zstandard.ZstdCompressor(level=3).compress
    rows = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        sizes = np.diff(offsets[a : z + 1]).astype("<u4")
        # lengths by planes of bytes, of which all but the first are nearly always zeros
        rows.append(pack((z - a).to_bytes(4, "little") + sizes.view(np.uint8).reshape(-1, 4).T.tobytes() + data[offsets[a] : offsets[z]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "words"])


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The hashes and words of packed rows."""
    open_ = zstandard.ZstdDecompressor().decompress
    sizes, data = [np.zeros(1, np.int64)], []
    for row in rows:
        raw = open_(row)
        n = int.from_bytes(raw[:4], "little")
        sizes.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").ravel())
        data.append(raw[4 + 4 * n :])
    data = b"".join(data)
    offsets = np.cumsum(np.concatenate(sizes), dtype=np.int64)
    places = np.zeros(len(data) + 1, np.int64)  # of bytes, among code points
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=places[1:])
    cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    h = word_hashes(cp, places[offsets[:-1]], places[offsets[1:]])
    return h, pa.LargeStringArray.from_buffers(len(h), pa.py_buffer(offsets), pa.py_buffer(data))


def _odd(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which of these slices differ from the slice of the number that like gives; about COMPARED code points at a time."""
    sizes = ends - starts
    odd = sizes != sizes[like]
    same = np.flatnonzero(~odd & (starts != starts[like]))
    block = np.cumsum(sizes[same]) // COMPARED
    for some in np.split(same, np.flatnonzero(np.diff(block)) + 1) if len(same) else ():
        n = sizes[some]
        differ = cp[spread(starts[some], n)] != cp[spread(starts[like[some]], n)]
        odd[some] = np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return odd


def _distinct(path: str, buckets: int) -> Callable:
    """(bucket, words) of a task's distinct words. Hashes only find what may be equal: words are compared themselves, and all words of one hash are passed on."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, place, held = Splitter(path), np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        odd: set[tuple[int, str]] = set()  # words beside the held ones of their hashes

        def keep(parts: list) -> None:
            nonlocal seen, place
            h = np.concatenate([p[3] for p in parts])
            which = np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])
            s, e = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            new, at, like = np.unique(h, return_index=True, return_inverse=True)
            words = pa.array([parts[w][0][a:b] for w, a, b in zip(which[at].tolist(), s[at].tolist(), e[at].tolist(), strict=True)], pa.large_string())
            cp = np.frombuffer("".join([p[0] for p in parts]).encode("utf-32-le", "surrogatepass"), np.uint32)
            base = np.cumsum([0, *(len(p[0]) for p in parts)])[which]
            for i in np.flatnonzero(_odd(cp, s + base, e + base, at[like])).tolist():
                odd.add((int(h[i]), parts[which[i]][0][s[i] : e[i]]))
            fresh = np.ones(len(new), bool)
            if len(seen):
                i = np.minimum(np.searchsorted(seen, new), len(seen) - 1)
                fresh = seen[i] != new
                known, mine = pa.chunked_array([w for _, w in held]).take(pa.array(place[i[~fresh]])), words.filter(pa.array(~fresh))
                for k in np.flatnonzero(pc.not_equal(known, mine).to_numpy()).tolist():
                    odd.add((int(new[~fresh][k]), mine[k].as_py()))
            new, n = new[fresh], len(seen)
            held.append((new, words.filter(pa.array(fresh))))
            seen, place = np.concatenate([seen, new]), np.concatenate([place, n + np.arange(len(new))])
            order = np.argsort(seen, kind="stable")
            seen, place = seen[order], place[order]

        def passed() -> pa.RecordBatch:
            nonlocal seen, place, held
            if odd:
                held.append((np.array([k for k, _ in odd], np.uint64), pa.array([w for _, w in odd], pa.large_string())))
            h = np.concatenate([x for x, _ in held])
            order = np.argsort(h)
            out = _packed(h[order], pa.concat_arrays([w for _, w in held]).take(pa.array(order)), buckets)
            seen, place, held = seen[:0], place[:0], []
            odd.clear()
            return out

        for b in batches:
            parts, n = [], 0
            for doc in _docs((x.as_py() for x in b.column(0)), split):
                for p in doc:
                    if isinstance(p, tuple) and len(p[1]):
                        parts.append(p)
                        n += len(p[1])
                if n > 400_000:
                    keep(parts)
                    parts, n = [], 0
            if parts:
                keep(parts)
            if len(seen) + len(odd) > REMEMBERED:
                yield passed()
        if held:
            yield passed()

    return found


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, last, met) of each hash in packed rows: a word, another one if several have this hash (else the same), and how often it came."""
    h, words, met = np.zeros(0, np.uint64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    other: dict[int, str] = {}
    rows, size = [], 0

    def merge() -> None:
        nonlocal h, words, met
        more, others = _unpacked(rows)
        order = np.argsort(np.concatenate([h, more]), kind="stable")
        h, words = np.concatenate([h, more])[order], pa.concat_arrays([words, others]).take(pa.array(order))
        met = np.concatenate([met, np.ones(len(more), np.int64)])[order]
        first = np.append(True, h[1:] != h[:-1])
        for i in np.flatnonzero(~first[1:] & pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)).tolist():
            a, z = words[i].as_py(), words[i + 1].as_py()
            at = np.searchsorted(h, h[i + 1])
            other[int(h[i + 1])] = z if z != words[int(at)].as_py() else a
        first = np.flatnonzero(first)
        h, words, met = h[first], words.take(pa.array(first)), np.add.reduceat(met, first)

    for b in batches:
        for row in b.column(1).to_pylist():
            rows.append(row)
            size += len(row)
            if size > MERGED_BYTES:
                merge()
                rows, size = [], 0
    if rows:
        merge()
    for a in range(0, len(h), ENCODED_WORDS):
        part, some = h[a : a + ENCODED_WORDS], words[a : a + ENCODED_WORDS]
        last = some
        if other:
            last = pa.array([other.get(k, w) for k, w in zip(part.tolist(), some.to_pylist(), strict=True)], pa.large_string())
        yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), some, last, pa.array(np.minimum(met[a : a + ENCODED_WORDS], MOST_MET).astype(np.int32))], ["h", "word", "last", "met"])


def _encoder(path: str) -> Callable:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kind = library(path), Splitter(path).kind
        for b in batches:
            ids = [np.array(e.ids, kind).tobytes() for e in t.encode_batch(b.column(1).to_pylist(), add_special_tokens=False)]
            ids = [None if x != y else i for i, x, y in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), b.column(3)], ["h", "ids", "met"])

    return encoded


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b


def word_table(docs: DataFrame, path: str, size: int | None = None) -> DataFrame:
    """(h, ids binary, met) of every distinct word of docs' texts (of that many bytes), written; ids is null where several words
    have one hash, met is how often tasks passed the word on, at most MOST_MET."""
    small_batches(docs.sparkSession)
    buckets = min(max(-(-(text_bytes(docs) if size is None else size) // WORDS_BYTES), 1), MOST_BUCKETS)
    words = docs.select("text").mapInArrow(lean(_distinct(path, buckets)), "bucket int, words binary")  # a task's words are distinct already
    return materialise(words.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(lambda rows: _encoder(path)(_merged(rows))), "h long, ids binary, met int"))


class Table:
    """Word hashes in order, with the ids of all words end to end; from the columns of a word table."""

    #: Words whose ids are moved at a time.
    PART = 500_000

    def __init__(self, h: pa.ChunkedArray, ids: pa.ChunkedArray, kind: np.dtype):
        h = np.concatenate([c.to_numpy() for c in h.chunks] or [np.zeros(0, np.int64)]).view(np.uint64)
        data, starts, sizes, at = [], [], [], 0
        for c in ids.chunks:
            wide = np.int64 if pa.types.is_large_binary(c.type) else np.int32
            offsets = np.frombuffer(c.buffers()[1], wide)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            if len(c):
                data.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind))
                starts.append(((offsets[:-1] - offsets[0]) // kind.itemsize + at).astype(np.uint32))
                sizes.append((np.diff(offsets) // kind.itemsize).astype(np.uint32))
                at += len(data[-1])
        order = np.argsort(h).astype(np.uint32)
        self.h = h[order]
        #: Hashes of several words.
        self.shared = np.sort(h[np.concatenate([np.asarray(c.is_null()) for c in ids.chunks])]) if ids.null_count else h[:0]
        if not len(h):
            self.offsets, self.ids = np.zeros(1, np.uint32), np.zeros(0, kind)
            return
        data = np.concatenate(data) if len(data) > 1 else data[0]
        starts, sizes = np.concatenate(starts)[order], np.concatenate(sizes)[order]
        self.offsets = np.zeros(len(h) + 1, np.uint32)
        np.cumsum(sizes, out=self.offsets[1:])
        self.ids = np.empty(at, kind)
        for a in range(0, len(h), self.PART):
            n, first = sizes[a : a + self.PART].astype(np.int64), self.offsets[a]
            ends = np.cumsum(n)
            self.ids[first : first + ends[-1]] = data[np.repeat(starts[a : a + self.PART] - (ends - n), n) + np.arange(ends[-1])]

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words given by their hashes: where their ids start, how many there are, and whether the table has the word."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        a = self.offsets[at].astype(np.int64)
        there = self.h[at] == h
        return a, np.where(there, self.offsets[at + 1].astype(np.int64) - a, 0), there

    def taken(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Slices of the ids that start at a and hold n, end to end."""
        return self.ids[spread(a, n)]


def spread(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from a on, for each a."""
    ends = np.cumsum(n)
    return np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def known(doc: list, words: Table, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A document's ids as far as words has them; the gaps' places among these ids, in order, and the gaps' word hashes."""
    ids, at, missing, m = [np.zeros(0, words.ids.dtype)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for p in doc:
        if isinstance(p, int):
            ids.append(np.array([p], words.ids.dtype))
            m += 1
            continue
        a, n, there = words.places(p[3])
        if len(words.shared) and (odd := np.isin(p[3], words.shared)).any():
            own = [library(path).encode(p[0][x:z], add_special_tokens=False).ids for x, z in zip(p[1][odd].tolist(), p[2][odd].tolist(), strict=True)]
            size = n.copy()
            size[odd] = [len(o) for o in own]
            found = np.empty(size.sum(), words.ids.dtype)
            mine = np.repeat(odd, size)
            found[mine] = [i for o in own for i in o]
            found[~mine] = words.taken(a[~odd], n[~odd])
            n = size
        else:
            found = words.taken(a, n)
        if not there.all():
            at.append(m + np.cumsum(n)[~there])
            missing.append(p[3][~there])
        ids.append(found)
        m += len(found)
    return np.concatenate(ids), np.concatenate(at), np.concatenate(missing)


def filled(ids: np.ndarray, at: np.ndarray, missing: np.ndarray, words: Table) -> np.ndarray:
    """ids with the gaps at those places filled with the missing words' ids."""
    if not len(missing):
        return ids
    a, n, there = words.places(missing)
    if not there.all():
        raise ValueError("a word isn't in the table")
    out = np.empty(len(ids) + n.sum(), ids.dtype)
    gap = np.zeros(len(out), bool)
    gap[spread(at + np.cumsum(n) - n, n)] = True
    out[gap] = words.taken(a, n)
    out[~gap] = ids
    return out


def head(words: DataFrame, head_bytes: int = HEAD_BYTES) -> tuple[DataFrame, int]:
    """The words that the most tasks met, as many as head_bytes hold, and the least met of them; words of one hash are always there."""
    size = words.groupBy("met").agg(F.sum(F.lit(12) + F.coalesce(F.octet_length("ids"), F.lit(0))).alias("b")).collect()
    least, total = MOST_MET + 1, 0
    for met, b in sorted(size, reverse=True):
        total += b
        if total > head_bytes:
            break
        least = met
    return words.where((F.col("met") >= least) | F.col("ids").isNull()).select("h", "ids"), least


def encode_with(docs: DataFrame, words: DataFrame, path: str, made: Callable, schema: str, head_bytes: int = HEAD_BYTES, size: int | None = None) -> DataFrame:
    """made(keys arrow array, iterator of id arrays) -> arrow batch, over docs (a key column and text of that many bytes), in any order."""
    spark = docs.sparkSession
    key = docs.columns[0]
    first, least = head(words.where("met > 1 or ids is null"), head_bytes)  # what one task met goes to that task's chunks alone
    rows = first.toArrow()
    held = spark.sparkContext.broadcast(Table(rows.column(0), rows.column(1), Splitter(path).kind))
    del rows

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
        split = Splitter(path)
        for b in batches:
            yield b, (known(d, held.value, path) for d in _docs((x.as_py() for x in b.column(1)), split))

    def gapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for b, docs_ in found(batches):
            chunks, ids, at, missing, ends = [], [], [], [], [0]
            for n, d in zip(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist(), docs_, strict=True):
                chunks.append(chunk)
                ids.append(d[0].tobytes())
                at.append(d[1].astype(np.uint32).tobytes())
                missing.append(d[2])
                ends.append(ends[-1] + len(d[2]))
                size += n
                if size >= CHUNK_BYTES:
                    chunk, size = chunk + 1, 0
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(missing).view(np.int64) if missing else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), b.column(0), pa.array(ids, pa.binary()), pa.array(at, pa.binary()), lists], ["chunk", key, "known", "places", "missing"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        words = Table(right.column("h"), right.column("ids"), Splitter(path).kind)
        batches = []
        for b in left.to_batches():
            h, ends = b.column("missing").values.to_numpy().view(np.uint64), b.column("missing").offsets.to_numpy()
            docs_ = (
                filled(np.frombuffer(ids, words.ids.dtype), np.frombuffer(at, np.uint32).astype(np.int64), h[x:z], words)
                for ids, at, x, z in zip(b.column("known").to_pylist(), b.column("places").to_pylist(), ends[:-1], ends[1:], strict=True)
            )
            batches.append(made(b.column(key), docs_))
        return pa.Table.from_batches(batches)

    buckets = -(-(text_bytes(docs) if size is None else size) // BUCKET_BYTES)
    gaps = docs.mapInArrow(lean(gapped), f"chunk long, `{key}` {docs.schema[key].dataType.simpleString()}, known binary, places binary, missing array<long>")
    gaps = materialise_buckets(gaps, "chunk", min(max(buckets, 1), MOST_BUCKETS))
    wanted = gaps.select(F.col("chunk").alias("of"), F.explode("missing").alias("h")).distinct().join(words.where(F.col("met") < least).select("h", "ids"), "h")
    return gaps.groupBy("chunk").cogroup(wanted.select("of", "h", "ids").groupBy("of")).applyInArrow(met, schema)


@functools.cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id's piece: the id-to-piece side of the decoding join."""
    with open(path) as f:
        spec = json.load(f)
    # fixed values: byte-level vocabularies write printable bytes as themselves and the others from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    out = [b""] * (1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])))
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def decoded(ids: np.ndarray, path: str) -> str:
    return b"".join(map(pieces(path).__getitem__, ids.tolist())).decode("utf-8", "replace")


def _digests(path: str) -> Callable:
    def made(keys: pa.Array, all_ids: Iterator[np.ndarray]) -> pa.RecordBatch:
        table_, names = pieces(path), _names(path)
        n, ids_sha, text_sha = [], [], []
        for ids in all_ids:
            ids = ids.tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            raw = b"".join(map(table_.__getitem__, ids))
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            text_sha.append(hashlib.sha256(raw).hexdigest())
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return made


@functools.cache
def _names(path: str) -> list[str]:
    return [str(i) for i in range(len(pieces(path)))]


def _ids(keys: pa.Array, all_ids: Iterator[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32()))], ["doc_id", "ids"])


def encoded(docs: DataFrame, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    return encode_with(docs, word_table(docs, path, size), path, _ids, "doc_id long, ids array<int>", head_bytes, size)


def round_trip(docs: DataFrame, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    return encode_with(docs, word_table(docs, path, size), path, _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", head_bytes, size)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))

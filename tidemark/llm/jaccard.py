"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of SHINGLE words (64-bit hashes). Equal sets are one node, so exact copies
never meet. The nodes are joined like this:

1.  All documents' shingles are counted in one sketch of fixed size; (estimate, hash) is the order from rare to common.
2.  A node with n shingles has at least a = ceil(0.8 n) in common with any partner, so among its first n - a + l shingles
    are at least min(l, l') of those that the partner has among its own. Each node picks the l from 1 to MOST_MATCHES for
    which reading the posting lists of a prefix plus verifying the candidates left by l matches is estimated
    cheapest: common prefixes are lengthened, and demand more matches.
3.  Prefix shingles held by one node only go. Star: in each posting list the smallest node is verified against the
    others; the components of the links found so far are computed. What is still outside a list's largest component is
    verified against one more member of that component, drawn by hash for each list. Rest: among the others, only members outside the list's
    largest component can still add anything; they meet the members of other components, in cells of bounded size,
    where pairs of too different lengths go, and those with fewer common prefix shingles than min(l, l') or than the
    overlap they need leaves to the prefix that ends first. Members of few open prefix shingles bring them along, so that their
    cell tells; a pair then counts only at its first common shingle. Pairs with a member of more than LISTED, whose list would be
    repeated in a row for each of its shingles, are counted over all cells instead. What is left is verified on the whole sets.

No list is ever turned into all its pairs: pairs within a component found by the star are skipped, so that large
groups of near copies cost about a pair per member. The result has the components, which these links span.

Nulls: null and empty texts, and those without words, have the empty set, no links, and their own id as component.
Fewer than SHINGLE words are one shingle. Rows that share a doc_id are one node for links; each is reported. Null ids
are reported without links. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Prefixes, components, lean, materialise, mixed, small_batches, table, texts

SHINGLE = 5
#: Jaccard similarity of at least PERCENT per cent.
PERCENT = 80
MOST_MATCHES = 4
#: Cost of verifying a candidate against reading one entry of a posting list.
VERIFY_COST = 8.0
#: Counters of the sketch, as a power of two, and the parts in which it is added up.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Members of a posting list that one task compares with those outside its largest component.
CELL = 1024
#: Members and common shingles that are counted at a time.
BLOCK, WIDE = 512, 4096
#: Open prefix shingles that travel with each row of a member; a member of more is counted pair by pair.
LISTED = 256
#: Ids that are broadcast at most (some 50 bytes each).
BROADCAST_IDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWERED = Prefixes.VALUES[_LOWER]
_PLACES = mixed(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(text: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles of a text's bytes."""
    edges = np.diff(np.concatenate(([False], ~_SPACE[text], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = Prefixes(_LOWERED[text]).words(starts, ends, lambda a, z: _LOWER[text[a:z]].tobytes())
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * _PLACES[i]
    return np.unique(mixed(h))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (size and a 128-bit key of its set) and, last, the task's part of the sketch."""
    names = ["doc_id", "n", "k1", "k2", "part", "counts"]
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for b in batches:
        n, keys = [], np.zeros((b.num_rows, 2), np.uint64)
        for i, text in enumerate(texts(b.column(1))):
            h = shingles(text)
            n.append(len(h))
            if len(h):
                keys[i] = mixed(h + np.uint64(1)).sum(), mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum()
                sketch[h >> np.uint64(64 - SKETCH_BITS)] += np.uint32(1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _signed(np.ascontiguousarray(keys[:, 0])), _signed(np.ascontiguousarray(keys[:, 1])), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names)
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [(i, pack(x.tobytes())) for i, x in enumerate(np.split(sketch, SKETCH_PARTS)) if x.any()]
    if rows:
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)


def _added(parts: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
    unpack = zstandard.ZstdDecompressor().decompress
    for x in parts.column("counts"):
        total += np.frombuffer(unpack(x.as_py()), np.uint32)
    return pa.table({"part": parts.column("part")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


def prefix(h: np.ndarray, estimates: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """The prefix of a set in rarity order, and the number of matches l that it demands."""
    n = len(h)
    order = np.lexsort((h, estimates))
    least = n + (n * PERCENT // -100) + 1  # n - ceil(0.8 n) + 1
    cost = np.cumsum(np.maximum(0.0, estimates[order].astype(np.float64) - noise))
    ls = range(1, min(MOST_MATCHES, n - least + 1) + 1)
    matches = min(ls, key=lambda m: (cost[least + m - 2] * (1 + VERIFY_COST / m), m))
    return h[order[: least + matches - 1]], matches


def _prefixes(sketch) -> callable:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        noise = float(counts.mean()) + 3 * float(counts.mean()) ** 0.5 + 1
        for b in batches:
            tokens, ids, sizes, demands = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                h = shingles(text)
                if len(h) and doc is not None:
                    first, matches = prefix(h, counts[h >> np.uint64(64 - SKETCH_BITS)], noise)
                    tokens.append(first)
                    ids.append(np.full(len(first), doc, np.int64))
                    sizes.append(np.full(len(first), len(h), np.int32))
                    demands.append(np.full(len(first), matches, np.int8))
            if tokens:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(demands))], ["token", "doc_id", "n", "matches"])

    return made


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed: smaller by far than their sets."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(t.tobytes()) for t in texts(b.column(1))], pa.binary())], ["doc_id", "packed"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b, x, y) whose whole sets are similar enough; x and y are the packed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    get = lambda z: shingles(np.frombuffer(unpack(z), np.uint8))
    last, x = None, None
    for b in batches:
        keep = []
        for i, y in enumerate(b.column(3).to_pylist()):
            if (z := b.column(2)[i].as_py()) != last:
                last, x = z, get(z)
            y = get(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b, need) of the sorted cells (token, cell, query, doc_id, n, matches, component, rest, opens, tokens).

    A pair of need 0 is a candidate; one of another need, which comes once for each common open shingle, if it comes so often.
    """
    held, key = [], None
    for b in batches:
        at = np.flatnonzero(np.concatenate(([True], (np.diff(b.column(0).to_numpy()) != 0) | (np.diff(b.column(1).to_numpy()) != 0))))
        for a, z in zip(at.tolist(), [*at[1:].tolist(), b.num_rows], strict=True):
            now = (b.column(0)[a].as_py(), b.column(1)[a].as_py())
            if now != key and held:
                yield from _pairs(pa.Table.from_batches(held))
                held = []
            key = now
            held.append(b.slice(a, z - a))
    if held:
        yield from _pairs(pa.Table.from_batches(held))


def _pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    query = cell.column("query").to_numpy()
    if query.all() or not query.any():
        return
    ids, n, demand, component, rest, opens = (cell.column(c).to_numpy() for c in ("doc_id", "n", "matches", "component", "rest", "opens"))
    listed = cell.column("tokens").is_valid().to_numpy()
    lists = cell.column("tokens").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    token = cell.column("token")[0].as_py()
    spare = n.astype(np.int64) - (n + n.astype(np.int64) * PERCENT // -100 + demand)  # shingles beyond the prefix
    blocks = lambda x: [(some, _flat(lists, some)) for some in np.array_split(x, -(-len(x) // BLOCK))]
    asked = blocks(np.flatnonzero(query))
    for others, theirs in blocks(np.flatnonzero(~query)):
        for some, own in asked:
            x, y = some[:, None], others[None, :]
            fits = (component[x] != component[y]) & (~rest[y] | (ids[x] < ids[y])) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
            if not fits.any():
                continue
            # of two prefixes, all that the one ending first shares with the other set lies in the other's prefix
            overlap = -(-PERCENT * (n[x].astype(np.int64) + n[y]) // (100 + PERCENT))
            need = np.maximum(np.minimum(demand[x], demand[y]), overlap - np.maximum(spare[x], spare[y]))
            fits &= np.minimum(opens[x], opens[y]) >= need
            told = listed[x] & listed[y]
            if (fits & told).any():
                both, before = _common(own, theirs, (len(some), len(others)), token)
                fits &= ~told | ((both >= need) & (before == 0))
            i, j = np.nonzero(fits)
            if len(i):
                a, b = ids[some[i]], ids[others[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.where(told, 0, need)[i, j], pa.int64())], ["a", "b", "need"])


def _flat(lists: pa.ListArray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of some lists in order, and which of those lists has each."""
    taken = lists.take(pa.array(some))
    values, where = taken.flatten().to_numpy(), np.repeat(np.arange(len(some)), np.diff(taken.offsets.to_numpy()))
    order = np.argsort(values)
    return values[order], where[order]


def _common(own: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], token: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of lists the number of common shingles, and of those below token."""
    both, before = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    shingles_ = np.intersect1d(own[0], theirs[0])
    for a in range(0, len(shingles_), WIDE):
        part = shingles_[a : a + WIDE]
        x, y = (_marks(side, part, rows) for side, rows in zip((own, theirs), shape, strict=True))
        both += x @ y.T
        if (cut := np.searchsorted(part, token)) > 0:
            before += x[:, :cut] @ y[:, :cut].T
    return both, before


def _marks(side: tuple[np.ndarray, np.ndarray], part: np.ndarray, rows: int) -> np.ndarray:
    a, z = np.searchsorted(side[0], part[0], "left"), np.searchsorted(side[0], part[-1], "right")
    values, where = side[0][a:z], side[1][a:z]
    at = np.searchsorted(part, values)
    there = part[at] == values
    out = np.zeros((rows, len(part)), np.float32)
    out[where[there], at[there]] = 1
    return out


def _verified(pairs: DataFrame, packed: DataFrame, broadcast_ids: int) -> DataFrame:
    """Those of the pairs (a, b), a written table, that link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    packed = packed.join(F.broadcast(ids) if 2 * pairs.count() <= broadcast_ids else ids, "doc_id", "left_semi")
    both = pairs.join(packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("y")), "b").join(packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(lean(_compared), "a long, b long")


def _placed(lists: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists with their members' components, and (token, most, size, parts) of those with several components."""
    placed = lists.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("size"), F.count("*").alias("parts"))
    return placed, sizes.where("parts > 1")


def linked(docs: DataFrame, cell: int = CELL, broadcast_ids: int = BROADCAST_IDS, listed: int = LISTED) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    small_batches(spark)
    summaries = materialise(docs.mapInArrow(lean(_summaries), "doc_id long, n long, k1 long, k2 long, part int, counts binary"))
    sums = summaries.where("part is not null").groupBy("part").applyInArrow(_added, "part int, counts binary").collect()
    sketch = bytearray(4 << SKETCH_BITS)
    width = len(sketch) // SKETCH_PARTS
    for r in sums:
        sketch[r.part * width : (r.part + 1) * width] = r.counts
    held = spark.sparkContext.broadcast(bytes(sketch))
    rows = summaries.where("part is null").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    nodes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"))

    own = materialise(docs.mapInArrow(lean(_prefixes(held)), "token long, doc_id long, n int, matches byte"))
    own = own.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lists = materialise(own.join(own.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "token", "left_semi"))
    ids = lists.select("doc_id").distinct()
    few = ids.count() <= broadcast_ids
    packed = materialise(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(lean(_packed), "doc_id long, packed binary"))

    first = lists.groupBy("token").agg(F.min(F.struct("doc_id", "n")).alias("p"))
    others = materialise(lists.join(first, "token").where("doc_id != p.doc_id").select("token", "doc_id", "n", "matches", "p"))
    near = "100 * least(n, p.n) >= %d * greatest(n, p.n)" % PERCENT
    star = materialise(others.where(near).select(F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = materialise(_verified(star, packed, broadcast_ids))
    known = materialise(components(links))

    # the smallest node of each list is done; of the others, what is outside the largest component remains
    others = others.drop("p")
    placed, sizes = _placed(others, known)
    hub = placed.join(sizes, "token").where("component = most.component").groupBy("token").agg(F.min(F.struct(F.xxhash64("doc_id", "token").alias("h"), "doc_id", "n")).alias("p"))
    second = placed.join(sizes.select("token", "most"), "token").where("component != most.component").join(hub, "token").where(near)
    second = materialise(second.select(F.least("p.doc_id", "doc_id").alias("a"), F.greatest("p.doc_id", "doc_id").alias("b")).distinct())
    links = links.unionByName(materialise(_verified(second, packed, broadcast_ids)))
    placed, sizes = _placed(others, materialise(components(links)))
    open_ = materialise(placed.join(sizes.select("token", F.col("most.component").alias("main"), F.ceil(F.col("size") / cell).cast("int").alias("cells")), "token").withColumn("rest", F.col("component") != F.col("main")))
    tokens = open_.groupBy("doc_id").agg(F.collect_list("token").alias("tokens")).select("doc_id", F.size("tokens").alias("opens"), F.when(F.size("tokens") <= listed, F.col("tokens")).alias("tokens"))
    member = open_.select("token", F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int").alias("cell"), F.lit(False).alias("query"), "doc_id", "n", "matches", "component", "rest")
    asks = open_.where("rest").select("token", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("query"), "doc_id", "n", "matches", "component", "rest")
    cells = member.unionByName(asks).join(tokens, "doc_id").select("token", "cell", "query", "doc_id", "n", "matches", "component", "rest", "opens", "tokens")
    found = cells.repartition("token", "cell").sortWithinPartitions("token", "cell").mapInArrow(lean(_rest), "a long, b long, need long")
    rest = materialise(found.groupBy("a", "b", "need").agg(F.count("*").alias("common")).where("common >= need").select("a", "b"))
    more = materialise(_verified(rest, packed, broadcast_ids))
    final = materialise(components(links.unionByName(more)))

    out = rows.join(nodes.select("k1", "k2", F.col("n_shingles").alias("n2"), "node"), (rows.k1 == nodes.k1) & (rows.k2 == nodes.k2) & (rows.n_shingles == F.col("n2")), "left").select("doc_id", "n_shingles", "node")
    return out.join(final.withColumnRenamed("component", "found"), "node", "left").select("doc_id", "n_shingles", F.coalesce("found", "node", "doc_id").alias("component_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))

"""Vector code compression: product codes whose codebooks come from Lloyd rounds by the filtering method.

1.  Trees: every partition builds a kd-tree over its vectors' parts, a tree for each part position and block of vectors. A node
    holds its bounding box and the count and componentwise sum of its parts. The trees are written once.
2.  Rounds: each tree is walked with the codebook's entries. At a node the entry nearest to the box's middle is kept, and so is
    every entry that is nearer than it to some point of the box; with one entry left, the whole subtree is its, by the cached
    sum and count. Only at leaves are parts compared one by one. Sums and counts of the entries are added up over tasks.
3.  Codes: a last walk gives each part its entry, and the errors.

Everything is integer arithmetic: results don't depend on blocks, partitions or machines. What the driver holds is a codebook:
ENTRIES entries of four parts, whatever the number of vectors.

Vectors that are null or hold a null or non-finite component are dropped. A vector of another length than that of the smallest
vec_id, or whose length isn't a positive multiple of four, has no code and no error (both null) and no part in the
codebooks. Components count as floor(1024 * x), within bound(). Rows that share a vec_id are ordered by their
vectors and coded each; a null vec_id comes last. Labels are summed with nulls together. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 4096, 16
#: Labels with at least this share of all rows are at most its inverse in number; they are broadcast, the others shuffled.
COMMON = 1e-3


class Tree:
    """A kd-tree over points (n x d integers); nodes are slices of `order`, children come after their parents."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        slices, children, stack = [], [], [(0, len(points), -1, 0)]
        while stack:
            a, z, parent, side = stack.pop()
            if parent >= 0:
                children[parent][side] = len(slices)
            own = points[self.order[a:z]]
            spread = own.max(0) - own.min(0)
            slices.append((a, z))
            children.append([-1, -1])
            if z - a > LEAF and spread.any():
                middle, axis = (z - a) // 2, int(spread.argmax())
                self.order[a:z] = self.order[a:z][np.argpartition(own[:, axis], middle)]
                stack += [(a + middle, z, len(slices) - 1, 1), (a, a + middle, len(slices) - 1, 0)]
        self.points = points[self.order]
        self.slices, self.children = np.array(slices, np.int32), np.array(children, np.int32)
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), self.points.cumsum(0)])
        self.sums = sums[self.slices[:, 1]] - sums[self.slices[:, 0]]
        self.low = np.stack([self.points[a:z].min(0) for a, z in slices])
        self.high = np.stack([self.points[a:z].max(0) for a, z in slices])

    #: What a written tree is made of.
    FIELDS = (("order", "<i4"), ("points", "<i4"), ("slices", "<i4"), ("children", "<i4"), ("sums", "<i8"), ("low", "<i4"), ("high", "<i4"))

    def written(self) -> list[bytes]:
        return [getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def read(cls, data: list[bytes], d: int) -> Tree:
        out = cls.__new__(cls)
        for (name, kind), raw in zip(cls.FIELDS, data, strict=True):
            values = np.frombuffer(raw, kind).astype(np.int64)
            setattr(out, name, values if name == "order" else values.reshape(-1, 2 if name in ("slices", "children") else d))
        return out

    def walk(self, book: np.ndarray) -> Iterator[tuple[int, np.ndarray | int]]:
        """(node, entry) of whole subtrees and (leaf, entries of its points), which together are all points; book: the entries (k x d)."""
        stack = [(0, np.arange(len(book)))]
        while stack:
            node, left = stack.pop()
            if len(left) > 1:
                left = self.kept(node, book, left)
            if len(left) == 1:
                yield node, int(left[0])
            elif self.children[node, 0] < 0:
                own = self.points[self.slices[node, 0] : self.slices[node, 1]]
                yield node, left[((own[:, None] - book[left]) ** 2).sum(2).argmin(1)]  # the first of equals
            else:
                stack += [(int(c), left) for c in self.children[node]]

    def kept(self, node: int, book: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Those of the entries `left` (ascending) that may be the nearest, the lowest of equals, to some point of the node's box."""
        low, high, own = self.low[node], self.high[node], book[left]
        best = left[((2 * own - (low + high)) ** 2).sum(1).argmin()]
        corner = np.where(own > book[best], high, low)  # where own is best off against it
        gain = ((own - corner) ** 2).sum(1) - ((book[best] - corner) ** 2).sum(1)
        return left[(gain < 0) | (gain == 0) & (left <= best)]

    def gathered(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Adds the points' sums and counts to those of their entries."""
        for node, entry in self.walk(book):
            a, z = self.slices[node]
            if isinstance(entry, int):
                sums[entry] += self.sums[node]
                counts[entry] += z - a
            else:
                np.add.at(sums, entry, self.points[a:z])
                np.add.at(counts, entry, 1)

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the points' first order."""
        entries = np.empty(len(self.order), np.int64)
        for node, entry in self.walk(book):
            entries[self.slices[node, 0] : self.slices[node, 1]] = entry
        errors = ((self.points - book[entries]) ** 2).sum(1)
        out = np.empty((2, len(entries)), np.int64)
        out[:, self.order] = entries, errors
        return out[0], out[1]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>, label) of rows whose vector is there and finite throughout."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label").where(F.col("vector").isNotNull() & F.forall("vector", finite))


def bound(d: int) -> int:
    """The largest component that leaves room for squared distances in 64 bits, among vectors of d components: 2**27 for 64 of them."""
    return min((1 << 31) - 1, isqrt((1 << 62) // (16 * max(1, d // PARTS))))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """Components of vectors of d components each, scaled and floored."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * values), -bound(d), bound(d)).astype(np.int64).reshape(-1, d)


def trees(vectors: DataFrame, d: int, block: int = BLOCK) -> DataFrame:
    """Written blocks of usable vectors of d components: (vec_ids, labels, trees), trees holding the fields of each part position's tree end to end."""
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made(b: pa.RecordBatch) -> pa.RecordBatch:
            whole = integers(b.column("vector"), d)
            data = [x for part in np.split(whole, PARTS, axis=1) for x in Tree(part).written()]
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.list_(pa.binary()))], ["vec_ids", "labels", "trees"])

        for b in batches:
            for a in range(0, b.num_rows, block):
                held.append(b.slice(a, block))
                n += held[-1].num_rows
                if n >= block:
                    yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return materialise(vectors.mapInArrow(lean(built), f"vec_ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<binary>"))


def _opened(b: pa.RecordBatch, d: int) -> Iterator[tuple[int, list[Tree]]]:
    n = len(Tree.FIELDS)
    for i, data in enumerate(b.column("trees").to_pylist()):
        yield i, [Tree.read(data[p * n : p * n + n], d // PARTS) for p in range(PARTS)]


def first_codebooks(vectors: DataFrame) -> np.ndarray:
    """Parts of the smallest vec_ids, by part position and entry; of no vectors, or such as can't be cut, an array without components."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    d = len(first[0].vector) if first else 0
    if not d or d % PARTS:
        return np.zeros((PARTS, 0, 0), np.int64)
    rows = vectors.where(F.size("vector") == d).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow().combine_chunks()
    whole = integers(rows.column("vector").combine_chunks(), d)
    return np.stack(np.split(whole, PARTS, axis=1))


def round_of(written: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one Lloyd round over written trees."""
    d = books.shape[2] * PARTS
    held = written.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(held.value.shape, np.int64), np.zeros(held.value.shape[:2], np.int64)
        for b in batches:
            for _, own in _opened(b, d):
                for p, tree in enumerate(own):
                    tree.gathered(held.value[p], sums[p], counts[p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = written.select("trees").mapInArrow(lean(summed), "part long, entry long, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(books.shape[2]))).alias("sums"))
    out = books.copy()
    for r in total.collect():  # at most PARTS x ENTRIES rows
        out[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    held.destroy()
    return out


def coded(written: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of written trees."""
    d = books.shape[2] * PARTS
    held = written.sparkSession.sparkContext.broadcast(books)
    kinds = [written.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, own in _opened(b, d):
                entries, errors = zip(*(tree.assigned(held.value[p]) for p, tree in enumerate(own)), strict=True)
                hexed = np.stack(entries, axis=1).astype(np.uint8).tobytes().hex()
                codes = [hexed[k : k + 2 * PARTS] for k in range(0, len(hexed), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([b.column("vec_ids")[i].values, b.column("labels")[i].values, pa.array(codes, pa.string()), pa.array(sum(errors))], ["vec_id", "label", "code", "error"])

    return written.mapInArrow(lean(found), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (a written table with label and error) with label_error: error summed over equal labels."""
    sums = materialise(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    least = (sums.agg(F.sum("n").alias("n")).first().n or 0) * COMMON
    common = sums.where(F.col("n") >= least).select(F.col("label").alias("_label"), "label_error")  # at most 1 / COMMON rows
    rare = sums.where(F.col("n") < least).select(F.col("label").alias("_label"), "label_error")
    met = rows.join(F.broadcast(common), F.col("label").eqNullSafe(F.col("_label")), "left_semi")
    rest = rows.join(F.broadcast(common), F.col("label").eqNullSafe(F.col("_label")), "left_anti")
    joined = met.join(F.broadcast(common), F.col("label").eqNullSafe(F.col("_label"))).unionByName(rest.join(rare, F.col("label").eqNullSafe(F.col("_label"))))
    return joined.drop("_label")


def compressed(vectors: DataFrame, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of each usable row of vectors (vec_id, embedding, label), and the codebooks (part, entry, component)."""
    vectors = usable(vectors)
    books = first_codebooks(vectors)
    d = books.shape[2] * PARTS
    other = vectors.where(F.size("vector") != d).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not d:
        return other.withColumn("label_error", F.col("error")), books
    written = trees(vectors.where(F.size("vector") == d), d, block)
    for _ in range(rounds):
        books = round_of(written, books)
    return with_label_errors(materialise(coded(written, books).unionByName(other))), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes (with a column code) with `vector`, the entries that stand for the parts, scaled back; null without a code."""
    held = F.array(*(F.array(*(F.array(*(F.lit(int(x) / SCALE) for x in entry)) for entry in book)) for book in books))
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.concat(*(F.get(held[p], entry(p)) for p in range(PARTS)))))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one by one, without trees: every part against every entry."""
    steps = [
        """kept AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "parts AS (SELECT vec_id, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS v FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p) g)",
        "book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS (SELECT vec_id, p, min(d).d AS d, min(d).entry AS entry FROM (
  SELECT a.vec_id, a.p, {{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(a.v, b.v)])::BIGINT, 'entry': b.entry}} AS d FROM parts a JOIN book{r} b ON a.p = b.p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""sums{r} AS (SELECT p, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT a.p, n.entry, unnest(a.v) AS x, unnest(range(len(a.v))) AS i FROM parts a JOIN near{r} n ON a.vec_id = n.vec_id AND a.p = n.p) GROUP BY p, entry, i)""")
            steps.append(f"means{r} AS (SELECT p, entry, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS v FROM sums{r} GROUP BY p, entry)")
            steps.append(f"book{r + 1} AS (SELECT b.p, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m ON b.p = m.p AND b.entry = m.entry)")
    last = ROUNDS
    steps.append(f"coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM kept k JOIN near{last} n ON k.vec_id = n.vec_id GROUP BY k.vec_id, k.label)")
    steps.append(f"hashed AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS h FROM book{last})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, hashed"


SQL = _sql()

"""Exact threshold pairs of embeddings by dual traversal of cover trees.

The top of the tree is fitted on a bounded sample: nested levels of centres whose radii halve, until there are enough
of them. Every vector goes to the cell of its nearest centre; cells are cut into blocks of bounded size, and a block
builds the lower levels from its own vectors, again nested and halving, down to half the distance that the threshold
allows. Each node knows its true covering radius. A dual traversal starts from pairs of blocks and prunes every pair of
nodes whose centres lie farther apart than the sum of their radii and that distance; what survives at the leaves is
compared in double precision, all of it, tile of blocks by tile of blocks. Blocks report counts of links and a spanning forest of them, never the
links of a dense cell.

Equal vectors are one vector with a number of copies, so that a very common one costs no more than any other.

In high dimensions most pairs of blocks survive (random unit vectors lie about as far apart as their cells are wide), so
the work grows with the square of the vectors there; it is spread over pairs of blocks.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component;
vectors of different lengths don't link. Repeated rows of one vec_id count as vectors of their own towards n_links,
and their rows carry the sum. Null vec_ids are reported without links. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, materialise, table

COSINE = 0.95
SAMPLE = 2048
BLOCK = 2500
#: Blocks on each side of what a task compares, at most: a block's tree goes to a task of each pair of tiles, not of blocks.
TILE = 8
#: Of centres at the top, at most.
MOST_CELLS = 1024
#: What single precision may be off by when nodes are pruned.
SLACK = 1e-4


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: cosines stay the same, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def net(x: np.ndarray, radius: float, first: list[int]) -> list[int]:
    """Indices of centres, first ones included, that cover the unit vectors x within radius."""
    near = np.full(len(x), np.inf)
    chosen = []
    todo = list(first)
    while True:
        i = todo.pop(0) if todo else int(np.argmax(near))
        if not todo and i not in first and near[i] <= radius:
            return chosen
        chosen.append(i)
        near = np.minimum(near, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[i]))))
        if len(chosen) >= len(x):
            return chosen


def top(sample: np.ndarray, cells: int) -> np.ndarray:
    """At most `cells` centres from nested nets of halving radii."""
    chosen, radius = [0], 2.0
    while len(chosen) < min(cells, len(sample)) and radius > 1e-3:
        radius /= 2
        chosen = net(sample, radius, chosen)[: max(cells, len(chosen))]
    return sample[chosen[:cells]]


class Tree:
    """Nested levels over a block: of each level the centres, covering radii and parents; leaves own ranges of vectors."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, least: float):
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        self.levels = []
        members, parents = [np.arange(len(ids))], [-1]
        radius = 1.0
        while True:
            centres, radii = [], []
            for m in members:
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit[m] @ unit[m[0]])))
                centres.append(m[0])
                radii.append(d.max())
            self.levels.append((unit[centres].astype(np.float32), np.array(radii, np.float32) + np.float32(1e-6), np.array(parents)))
            if max(radii) <= least or radius < least / 2:
                break
            radius = max(radius / 2, least / 2)
            below, parents = [], []
            for k, (m, r) in enumerate(zip(members, radii, strict=True)):
                if r <= radius:
                    below.append(m)
                    parents.append(k)
                    continue
                left = m
                while len(left):
                    d = np.sqrt(np.maximum(0, 2 - 2 * (unit[left] @ unit[left[0]])))
                    inside = d <= radius
                    inside[0] = True
                    below.append(left[inside])
                    parents.append(k)
                    left = left[~inside]
            members = below
        order = np.concatenate(members)
        self.ids, self.copies, self.raw = ids[order], copies[order].astype(np.float64), raw[order]
        self.leaf = np.repeat(np.arange(len(members)), [len(m) for m in members])


def surviving(a: Tree, b: Tree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the vectors of a and b in leaves that some pair of nodes leaves unpruned."""
    at, bt = np.ones(1, bool), np.ones(1, bool)
    for k in range(max(len(a.levels), len(b.levels))):
        (ca, ra, pa_), (cb, rb, pb) = a.levels[min(k, len(a.levels) - 1)], b.levels[min(k, len(b.levels) - 1)]
        if k and k < len(a.levels):
            at = at[pa_]
        if k and k < len(b.levels):
            bt = bt[pb]
        i, j = np.flatnonzero(at), np.flatnonzero(bt)
        at, bt = np.zeros(len(ca), bool), np.zeros(len(cb), bool)
        for some in np.array_split(i, -(-len(i) // 1024)) if len(i) and len(j) else []:
            c = ca[some] @ cb[j].T
            widest = min(2.0, reach + float(ra[some].max()) + float(rb[j].max()))
            x, y = np.nonzero(c >= 1 - widest * widest / 2 - SLACK)
            far = np.minimum(2.0, reach + ra[some][x] + rb[j][y])
            keep = c[x, y] >= 1 - far * far / 2 - SLACK
            at[some[x[keep]]] = True
            bt[j[y[keep]]] = True
    return at[a.leaf], bt[b.leaf]


def _dual(least: float, reach: float, tile: int):
    """Of a pair of tiles (i, j) of blocks, all pairs of their blocks, each once."""

    def joined(rows: pa.Table) -> pa.Table:
        trees = {k: pickle.loads(x.as_py()) for k, x in zip(rows.column("own").to_pylist(), rows.column("tree"), strict=True)}
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        return pa.concat_tables([compared(trees[a], trees[b], a == b) for a in sorted(trees) if a // tile == i for b in sorted(trees) if b // tile == j and a <= b])

    def compared(a: Tree, b: Tree, same: bool) -> pa.Table:
        i, j = (np.flatnonzero(m) for m in surviving(a, b, reach))
        ids, found = np.zeros(0, np.int64), []
        counts = (np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64))
        norms_b = np.sqrt((b.raw[j] ** 2).sum(1))
        for some in np.array_split(i, -(-len(i) // 512)) if len(i) and len(j) else []:
            c = (a.raw[some] @ b.raw[j].T) / (np.sqrt((a.raw[some] ** 2).sum(1))[:, None] * norms_b)
            link = c >= least
            if same:
                link &= some[:, None] != j[None, :]
            counts[0][some] += (link @ b.copies[j]).astype(np.int64)
            counts[1][j] += (a.copies[some] @ link).astype(np.int64)
            x, y = np.nonzero(link)
            found.append((some[x], j[y]))
        out = {"vec_id": [], "n": [], "other": []}

        def put(v: np.ndarray, n: np.ndarray, other: np.ndarray | None) -> None:
            out["vec_id"].append(pa.array(v, pa.int64()))
            out["n"].append(pa.array(n, pa.int64()))
            out["other"].append(pa.array(other, pa.int64()) if other is not None else pa.nulls(len(v), pa.int64()))

        for t, n in ((a, counts[0]),) if same else ((a, counts[0]), (b, counts[1])):
            some = np.flatnonzero(n)
            put(t.ids[some], n[some], None)
        if found:
            x, y = (np.concatenate(f) for f in zip(*found, strict=True))
            ids = a.ids if same else np.concatenate((a.ids, b.ids))
            y = y if same else y + len(a.ids)
            label = np.arange(len(ids))
            while len(x):
                new = label.copy()
                low = np.minimum(label[x], label[y])
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            some = np.flatnonzero(label != np.arange(len(ids)))
            put(ids[some], np.zeros(len(some), np.int64), ids[label[some]])
        schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
        return pa.table({k: pa.chunked_array(v or [pa.nulls(0, pa.int64())]) for k, v in out.items()}, schema=schema)

    return joined


def _built(reach: float):
    def built(part: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(part.column("raw").to_pylist()), np.float64).reshape(part.num_rows, -1)
        t = Tree(part.column("vec_id").to_numpy(), part.column("copies").to_numpy(), raw, reach / 2)
        return pa.table({"cell": part.column("cell")[:1], "sub": part.column("sub")[:1], "centre": pa.array([t.levels[0][0][0].tobytes()], pa.binary()), "radius": pa.array([float(t.levels[0][1][0])]), "tree": pa.array([pickle.dumps(t, 5)], pa.binary())})

    return built


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n, other) for distinct vectors (vec_id, embedding, copies): parts of their numbers of links to the copies of others
    (other null), and a spanning forest of the links (n 0)."""
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine))
    dims = [r.d for r in vectors.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    out = None
    for dim in dims:
        own = vectors.where(F.size("embedding") == dim).select("vec_id", "embedding", "copies")
        n = own.count()
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        units = scaled(np.array([r.embedding for r in sample]))
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        centres = spark.sparkContext.broadcast(top(units, max(1, min(MOST_CELLS, n // block))))

        def celled(batches: Iterator[pa.RecordBatch], centres=centres, dim=dim) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = scaled(b.column(1).flatten().to_numpy().reshape(b.num_rows, dim)) if b.num_rows else np.zeros((0, dim))
                cells = np.argmax(v / np.linalg.norm(v, axis=1, keepdims=True) @ centres.value.T, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cells.astype(np.int32)), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "copies", "cell", "raw"])

        placed = materialise(own.mapInArrow(celled, "vec_id long, copies long, cell int, raw binary"))
        cells = placed.groupBy("cell").agg(F.count("*").alias("c"))
        cut = placed.join(F.broadcast(cells), "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit("sub")), F.ceil(F.col("c") / block)).cast("int"))

        blocks = materialise(cut.select("cell", "sub", "vec_id", "copies", "raw").groupBy("cell", "sub").applyInArrow(_built(reach), "cell int, sub int, centre binary, radius double, tree binary"))
        # a few numbers a block; blocks grow with the square root of what they can't outnumber
        tops = blocks.select("cell", "sub", "centre", "radius").orderBy("cell", "sub").collect()
        held = spark.sparkContext.broadcast(({(t.cell, t.sub): k for k, t in enumerate(tops)}, np.array([np.frombuffer(t.centre, np.float32) for t in tops]), np.array([t.radius for t in tops])))

        tile = max(1, min(TILE, len(tops) // TILE))

        def dealt(batches: Iterator[pa.RecordBatch], held=held, reach=reach, tile=tile) -> Iterator[pa.RecordBatch]:
            number, points, radii = held.value
            for b in batches:
                for r in range(b.num_rows):
                    k = number[b.column(0)[r].as_py(), b.column(1)[r].as_py()]
                    d = np.sqrt(np.maximum(0, 2 - 2 * (points @ points[k])))
                    for other in np.unique(np.flatnonzero(d <= reach + radii + radii[k] + SLACK) // tile).tolist():
                        yield pa.RecordBatch.from_arrays([pa.array([min(k // tile, other)]), pa.array([max(k // tile, other)]), pa.array([k]), b.column(2).slice(r, 1)], ["i", "j", "own", "tree"])

        pairs = blocks.select("cell", "sub", "tree").mapInArrow(dealt, "i long, j long, own long, tree binary")
        found = materialise(pairs.repartition(max(len(tops), 6), "i", "j").groupBy("i", "j").applyInArrow(_dual(cosine, reach, tile), "vec_id long, n long, other long"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "vec_id long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    rows = rows.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    nodes = rows.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = rows.join(nodes.where("copies > 1"), "embedding").select("vec_id", "node", "first", "copies")
    members = materialise(members.unionByName(nodes.where("copies = 1").select(F.col("first").alias("vec_id"), "node", "first", "copies")))
    found = materialise(links(nodes.select(F.col("node").alias("vec_id"), "embedding", "copies"), cosine, block))
    counts = found.where("other is null").groupBy(F.col("vec_id").alias("node")).agg(F.sum("n").alias("n"))
    counts = members.join(counts, "node", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ends = nodes.select("node", "first")
    forest = found.where("other is not null").join(ends.select(F.col("node").alias("vec_id"), F.col("first").alias("u")), "vec_id").join(ends.select(F.col("node").alias("other"), F.col("first").alias("v")), "other")
    classes = components(forest.select("u", "v").unionByName(members.where("vec_id != first").select(F.col("vec_id").alias("u"), F.col("first").alias("v"))))
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

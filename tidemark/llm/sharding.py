"""Sharding by a hierarchical weighted hash tree (the law `key`: id and shard count alone decide).

A key descends from region to rack to shard. At each level every child draws -ln(u)/weight from a hash u of the key and
the child's own name, and the least draw wins, so that children win in proportion to their weights and a change of one
child's weight moves keys only into it (if it grew) or out of it (if it shrank). The base tree has regions of
RACKS x SHARDS leaves; each further shard opens a branch of its own, whose weight alone changes, so growing by
one moves rows only into the new shard.

Slots number a shard's rows without gaps: rows are dealt to many small cells within a shard by id and text, numbered there, and
moved up by the counts of the cells before; no task sees a whole shard, nor all rows of one id unless their texts are equal too. Nulls: a null text has no bytes, size 1 and
crc32 0; a null id is a key like any other. Repeated rows get slots of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

N_SHARDS = 16
RACKS, SHARDS = 2, 4
#: Shards of the base tree. Fixed: another size would move rows among old shards.
BASE = 16
#: Rows of a slot-numbering cell, about.
CELL_ROWS = 20_000


def tree(n: int) -> list[list[list[int]]]:
    """Regions of racks of shard numbers: the base tree, then a branch for each further shard."""
    regions = [[[r + k * SHARDS + s for s in range(SHARDS)] for k in range(RACKS)] for r in range(0, BASE, RACKS * SHARDS)]
    return regions + [[[s]] for s in range(BASE, n)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / F.lit(float(weight))


def _descend(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw."""
    if len(children) == 1:
        return children[0][2]
    return F.array_min(F.array(*(F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (name, w, v) in enumerate(children)))).getField("v")


def shard_of(key: Column, n: int, weights: dict[int, float] | None = None) -> Column:
    """The shard of a key among n; weights: of shards, 1 each if unnamed."""
    w = lambda s: (weights or {}).get(s, 1.0)
    regions = []
    for region in tree(n):
        first = region[0][0]
        racks = [(f"rack {rack[0]}", sum(map(w, rack)), _descend(key, [(f"shard {s}", w(s), F.lit(s)) for s in rack])) for rack in region]
        regions.append((f"region {first}", sum(x[1] for x in racks), _descend(key, racks)))
    leaf = _descend(key, regions)
    if n < BASE:
        leaf = F.when(leaf < n, leaf).otherwise(_descend(key, [(f"instead {s}", w(s), F.lit(s)) for s in range(n)]))
    return leaf.cast("int")


def sharded(docs: DataFrame, n: int = N_SHARDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    cells = max(1, -(-docs.count() // (n * cell_rows)))
    key = F.col("doc_id")
    cell = F.pmod(F.xxhash64(key, raw), F.lit(cells)).alias("cell")  # with the text, so that rows of one id spread
    out = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), shard_of(key, n).alias("shard"), shard_of(key, n + 1).alias("grown_shard"), cell)
    places = docs.select(shard_of(key, n).alias("shard"), cell).groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    numbered = out.withColumn("at", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1)
    placed = numbered.join(places.select("shard", "cell", before.alias("before")), ["shard", "cell"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))

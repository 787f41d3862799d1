"""Sums of products of every two tickers' series, tile by tile, so that no row is made for a pair and a date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tickers of a block and dates of a chunk, about; a tile holds two blocks' values on one chunk's dates.
BLOCK, CHUNK = 256, 256
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the tile's dates for each two tickers of its blocks that share one, the smaller name first."""
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    at, days = pd.factorize(rows["date"])
    sides = []
    for block in dict.fromkeys((i, j)):
        own = (rows["block"] == block).to_numpy()
        which, names = pd.factorize(rows["ticker"][own], sort=True)
        there, x = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        there[at[own], which], x[at[own], which] = 1.0, rows["x"][own]
        sides.append((np.asarray(names, object), there, x))
    (a, m, x), (b, k, y) = sides[0], sides[-1]
    sums = {"n": m.T @ k, "sx": x.T @ k, "sy": m.T @ y, "sxx": (x * x).T @ k, "syy": m.T @ (y * y), "sxy": x.T @ y}
    ordered = a[:, None] <= b[None, :]
    keep = (sums["n"] > 0) & (ordered if i == j else True)
    left, right = np.nonzero(keep)
    straight = ordered[keep].astype(bool)
    out = {"t1": np.where(straight, a[left], b[right]), "t2": np.where(straight, b[right], a[left])}
    turned = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
    for s in SUMS:
        out[s] = np.where(straight, sums[s][keep], sums[turned.get(s, s)][keep])
    return pd.DataFrame(out)


def pair_sums(rows: DataFrame, value: str, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(t1, t2, n, sx, sy, sxx, syy, sxy) over the dates that both tickers have, t1 <= t2, values less their ticker's mean.

    A row goes once to each block of tickers; a tile's sums are matrix products, and tiles are added up by pair. A ticker
    has one row a date; nulls of any column and values that aren't finite are left out.
    """
    x = F.col(value).cast("double")
    rows = rows.select("date", "ticker", x.alias("x")).where("date is not null and ticker is not null and x is not null and abs(x) < double('Infinity')")
    sizes = rows.agg(F.approx_count_distinct("ticker").alias("tickers"), F.approx_count_distinct("date").alias("dates"))
    sizes = sizes.select(F.greatest(F.ceil(F.col("tickers") / block), F.lit(1)).alias("blocks"), F.greatest(F.ceil(F.col("dates") / chunk), F.lit(1)).alias("chunks"))
    middle = rows.groupBy("ticker").agg(F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.avg("x")).alias("middle"))
    rows = rows.join(middle, "ticker").join(F.broadcast(sizes))
    rows = rows.select("date", "ticker", (F.col("x") - F.col("middle")).alias("x"), F.expr("pmod(xxhash64(ticker), blocks)").alias("block"), F.expr("pmod(xxhash64(date), chunks)").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "date", "ticker", "x")
    tiles = rows.groupBy("chunk", "i", "j").applyInPandas(_tile, "t1 string, t2 string, " + ", ".join(f"{s} double" for s in SUMS))
    return tiles.groupBy("t1", "t2").agg(*(F.sum(s).alias(s) for s in SUMS))

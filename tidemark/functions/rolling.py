"""Window expressions per ticker and per date; all of a kind share one exchange and sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def __getattr__(name: str):
    """TICKER, UP_TO_NOW and DATE, made when asked for: window specifications need a running session."""
    if name == "TICKER":
        return Window.partitionBy("ticker").orderBy("date")
    if name == "UP_TO_NOW":
        return Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    if name == "DATE":
        return Window.partitionBy("date")
    raise AttributeError(name)


def rows(n: int):
    return Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)


def full(made: Column, x: str, n: int, least: int | None = None) -> Column:
    """made over the last n rows, where at least so many of x are there."""
    w = rows(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), made.over(w))


def mean(x: str, n: int, least: int | None = None) -> Column:
    return full(F.avg(x), x, n, least)


def deviation(x: str, n: int, least: int | None = None) -> Column:
    return full(F.stddev_samp(x), x, n, least)


def zscore(x: str, n: int) -> Column:
    d = deviation(x, n)
    return F.when(d > 0, (F.col(x) - mean(x, n)) / d)


def skewness(x: str, n: int) -> Column:
    """Bias-adjusted: population skewness times sqrt(n(n-1))/(n-2). Null without spread."""
    c = F.count(x).over(rows(n))
    spread = F.stddev_pop(x).over(rows(n))
    return F.when((c >= n) & (spread > 0), F.skewness(x).over(rows(n)) * F.sqrt(c * (c - 1)) / (c - 2))


def kurtosis(x: str, n: int) -> Column:
    """Unbiased excess kurtosis. Null without spread."""
    c = F.count(x).over(rows(n))
    spread = F.stddev_pop(x).over(rows(n))
    return F.when((c >= n) & (spread > 0), (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.kurtosis(x).over(rows(n)) + 6))


def lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(Window.partitionBy("ticker").orderBy("date"))


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1 on, ties sharing their mean; null for null."""
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2)


def spread_rank(df: DataFrame, x: str, by: str, out: str, parts: int = 64) -> DataFrame:
    """df with out, the average rank of x (no nulls) in its group; each of a few large groups is ordered in parts.

    Approximate quantiles cut a group into ranges of x; a row's rank is its rank in its range after the rows of those below.
    """
    cuts = df.groupBy(by).agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 100 * parts).alias("__cuts"))
    df = df.join(F.broadcast(cuts), by).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts")
    sizes = df.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    below = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "__part", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"))
    df = df.withColumn("__rank", average_rank(x, by, "__part")).join(F.broadcast(sizes), [by, "__part"])
    return df.withColumn(out, F.col("__rank") + F.col("__below")).drop("__part", "__rank", "__below")


def smoothed(df: DataFrame, x: str, out: str, alpha: float) -> DataFrame:
    """df with out: e of the first non-null x is x itself, later e is alpha x + (1 - alpha) e before; null where x is.

    The recursion in closed form: sums of x weighted by growing powers, within blocks short enough that no power
    overflows and long enough that what a block before the last one adds is below double precision.
    """
    keep = 1 - alpha
    ticker = Window.partitionBy("ticker").orderBy("date")
    up_to_now = ticker.rowsBetween(Window.unboundedPreceding, 0)
    block = max(1, int(600 / -math.log(keep)))
    n, k, z, own, carry = (f"__{out}_{s}" for s in "nkzoc")
    df = df.withColumn(n, F.count(x).over(up_to_now) - 1)
    df = df.withColumns({k: F.expr(f"{n} div {block}"), z: F.when(F.col(n) == 0, F.col(x)).otherwise(F.col(x) * alpha)})
    at = (F.col(n) % block).cast("double")
    within = Window.partitionBy("ticker", k).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(own, F.sum(F.when(F.col(x).isNotNull(), F.col(z) * F.pow(F.lit(1 / keep), at))).over(within) * F.pow(F.lit(keep), at))
    df = df.withColumn(carry, F.lag(own).over(ticker))
    df = df.withColumn(carry, F.coalesce(F.first(carry).over(within), F.lit(0.0)))
    df = df.withColumn(out, F.when(F.col(x).isNotNull(), F.col(own) + F.when(F.col(k) > 0, F.col(carry) * F.pow(F.lit(keep), at + 1)).otherwise(0.0)))
    return df.drop(n, k, z, own, carry)

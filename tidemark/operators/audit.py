"""Look-ahead audit: a feature that changes when later rows are cut off has looked at them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.market import written


def look_ahead(rows: DataFrame, made: Callable[[DataFrame], DataFrame], columns: list[str], cuts: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """(feature, compared, changed): made(rows) computed once for all rows and for the rows up to each of some dates, and compared date by date.

    All versions are computed in one plan, told apart by the ticker: made() works on each ticker by itself."""
    share = [i / (cuts + 1) for i in range(1, cuts + 1)]
    days = F.percentile_approx(F.unix_date("date"), share, 10_000)
    ends = rows.agg(days.alias("d")).select(F.concat(F.array(F.lit(None).cast("date")), F.transform("d", F.date_from_unix_date)).alias("ends"))
    each = rows.join(F.broadcast(ends)).withColumn("end", F.explode(F.array_distinct("ends"))).where("end is null or date <= end").drop("ends")  # ends is one row
    named = each.withColumn("ticker", F.concat("ticker", F.lit("\x01"), F.coalesce(F.col("end").cast("string"), F.lit("")))).drop("end")
    got = written(made(named).select("date", F.split_part("ticker", F.lit("\x01"), F.lit(1)).alias("ticker"), F.split_part("ticker", F.lit("\x01"), F.lit(2)).alias("end"), *columns))
    whole = got.where("end = ''").select("date", "ticker", *(F.col(c).alias(f"whole_{c}") for c in columns))
    both = got.where("end != ''").join(whole, ["date", "ticker"])
    near = lambda a, b: F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(a.eqNullSafe(b) | (F.abs(a - b) <= tolerance * (1 + F.abs(a))))
    sums = both.agg(F.count("*").alias("compared"), *(F.count_if(~near(F.col(c).cast("double"), F.col(f"whole_{c}").cast("double"))).alias(c) for c in columns))
    return sums.select("compared", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("changed")) for c in columns)))).select("feature", "compared", "changed")

"""Cleaning, alignment, data quality and summaries of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import rolling as R
from ..functions.products import SUMS, pair_sums
from ..sources.market import business_days

PRICES = ("open", "high", "low", "close")


def clean(bars: DataFrame) -> DataFrame:
    """Prices filled forward up to 3 rows, rows without close or volume dropped, returns added, the first row dropped."""
    filled = bars.withColumns({c: F.last_value(F.col(c), True).over(R.TICKER.rowsBetween(-3, 0)) for c in PRICES})
    kept = filled.where("close is not null and volume > 0")
    before = R.lag("close")
    out = kept.withColumns({"return": F.try_divide("close", before) - 1, "log_return": F.ln(F.try_divide("close", before)), "dollar_volume": F.col("close") * F.col("volume")})
    return out.where(F.col("return").isNotNull())


def aligned(clean_bars: DataFrame) -> DataFrame:
    """Rows of dates on which every ticker has one."""
    n = clean_bars.select("ticker").distinct().agg(F.count("*").alias("n"))
    return clean_bars.withColumn("c", F.count("ticker").over(R.DATE)).join(F.broadcast(n), F.col("c") == F.col("n")).drop("c", "n")


def wide(rows: DataFrame, value: str, tickers: list[str]) -> DataFrame:
    return rows.groupBy("date").pivot("ticker", tickers).agg(F.first(value))


def dense(rows: DataFrame, *values: str) -> DataFrame:
    """A row for each ticker and each date that any ticker has."""
    spine = rows.select("date").distinct().join(F.broadcast(rows.select("ticker").distinct()))
    return spine.join(rows.select("date", "ticker", *values), ["date", "ticker"], "left")


def validate(bars: DataFrame) -> DataFrame:
    """(ticker, check, severity, n) of failed checks: hard issues and warnings."""
    change = F.abs(F.try_divide("close", R.lag("close")) - 1)
    seen = bars.withColumn("change", change).groupBy("ticker").agg(
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"), F.count_if(F.col("close") > F.col("high") * 1.001).alias("close_above_high"), F.count_if(F.col("close") < F.col("low") * 0.999).alias("close_below_low"),
        F.count_if((F.col("open") < 0) | (F.col("high") < 0) | (F.col("low") < 0) | (F.col("close") < 0)).alias("negative_price"), F.count_if(F.col("change") > config.MAX_DAILY_RETURN).alias("return_spike"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(F.col("volume") < config.MIN_DAILY_VOLUME).alias("low_volume"), F.count_if(F.dayofweek("date").between(2, 6)).alias("present"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    expected = F.size(F.filter(F.sequence("first", "last", F.expr("interval 1 day")), lambda d: F.dayofweek(d).between(2, 6)))
    seen = seen.withColumn("missing", (expected - F.col("present")).cast("long")).withColumn("ratio", F.try_divide("missing", expected))
    seen = seen.withColumns({"missing_days": F.when(F.col("ratio") <= config.MAX_MISSING_RATIO, F.col("missing")).otherwise(0), "too_many_missing": F.when(F.col("ratio") > config.MAX_MISSING_RATIO, F.col("missing")).otherwise(0)})
    hard, soft = ("high_below_low", "close_above_high", "close_below_low", "negative_price", "too_many_missing"), ("return_spike", "missing_days", "zero_volume", "low_volume")
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col(c).cast("long").alias("n")) for s, cs in (("issue", hard), ("warning", soft)) for c in cs))
    return seen.select("ticker", F.inline(rows)).where("n > 0")


def missing_bars(bars: DataFrame) -> DataFrame:
    """Expected business days of the whole range against the days that each ticker has."""
    days = business_days(span(bars)).agg(F.count("*").alias("expected_days"))
    have = bars.where("close is not null").groupBy("ticker").agg(F.count("*").alias("actual_days"))
    out = have.join(F.broadcast(days)).withColumn("missing_days", F.col("expected_days") - F.col("actual_days"))
    return out.withColumn("missing_ratio", F.col("missing_days") / F.col("expected_days")).withColumn("passed", F.col("missing_ratio") <= config.MAX_MISSING_RATIO)


def return_spikes(clean_bars: DataFrame, limit: float = config.MAX_DAILY_RETURN) -> DataFrame:
    r = F.when(F.abs("return") > limit, F.col("return"))
    out = clean_bars.groupBy("ticker").agg(F.count(r).alias("spike_count"), F.coalesce(F.max(r), F.lit(0.0)).alias("max_return"), F.coalesce(F.min(r), F.lit(0.0)).alias("min_return"), F.array_sort(F.collect_list(F.when(r.isNotNull(), F.date_format("date", "yyyy-MM-dd")))).alias("d"))
    return out.withColumn("spike_dates", F.array_join("d", ",")).drop("d")


def zero_volume(bars: DataFrame) -> DataFrame:
    zero = F.col("volume") == 0
    out = bars.groupBy("ticker").agg(F.count_if(zero).alias("zero_days"), F.try_divide(F.count_if(zero), F.count("volume")).alias("zero_ratio"), F.slice(F.array_sort(F.collect_list(F.when(zero, F.date_format("date", "yyyy-MM-dd")))), 1, 3).alias("d"))
    return out.withColumn("first_dates", F.array_join("d", ",")).drop("d")


def ohlc_sanity(bars: DataFrame) -> DataFrame:
    out = bars.groupBy("ticker").agg(F.count_if(F.col("high") < F.col("low")).alias("high_below_low"), (F.count_if(F.col("close") < F.col("low")) + F.count_if(F.col("close") > F.col("high"))).alias("close_outside"))
    return out.withColumn("errors", F.col("high_below_low") + F.col("close_outside")).withColumn("passed", F.col("errors") == 0)


def span(bars: DataFrame) -> DataFrame:
    """One row: the first and the last date."""
    return bars.agg(F.min("date").alias("first"), F.max("date").alias("last"))


def price_gaps(bars: DataFrame, most: int = config.MAX_GAP) -> DataFrame:
    """Runs of more than `most` missing business days, of consecutive calendar days (so weekends end a run)."""
    every = business_days(span(bars)).join(F.broadcast(bars.select("ticker").distinct()))
    absent = every.join(bars.where("close is not null").select("date", "ticker"), ["date", "ticker"], "left_anti")
    island = F.date_sub("date", F.row_number().over(R.TICKER))
    return absent.withColumn("island", island).groupBy("ticker", "island").agg(F.min("date").alias("gap_start"), F.max("date").alias("gap_end"), F.count("*").alias("days")).where(F.col("days") > most).drop("island")


def quality_report(bars: DataFrame) -> DataFrame:
    """Missing days, spikes, zero volume and impossible prices of each ticker with a close, in one pass over the bars; gaps beside them.

    Spikes are those of the cleaned bars: a window keeps the close of the last bar that cleaning would keep.
    """
    gaps = price_gaps(bars).groupBy("ticker").agg(F.count("*").alias("large_gaps"), F.max("days").alias("max_gap_days"))
    days = business_days(span(bars)).agg(F.count("*").alias("expected_days"))
    rows = bars.withColumn("filled", F.last_value("close", True).over(R.TICKER.rowsBetween(-3, 0))).withColumn("kept", F.when(F.col("volume") > 0, F.col("filled")))
    rows = rows.withColumn("change", F.try_divide("kept", F.last_value("kept", True).over(R.TICKER.rowsBetween(Window.unboundedPreceding, -1))) - 1)
    spike, zero = F.when(F.abs("change") > config.MAX_DAILY_RETURN, F.col("change")), F.col("volume") == 0
    out = rows.groupBy("ticker").agg(
        F.count("close").alias("actual"), F.count(spike).alias("spike_count"), F.coalesce(F.max(spike), F.lit(0.0)).alias("max_return"), F.coalesce(F.min(spike), F.lit(0.0)).alias("min_return"), F.count_if(zero).alias("zero_days"),
        F.try_divide(F.count_if(zero), F.count("volume")).alias("zero_ratio"), (F.count_if(F.col("high") < F.col("low")) + F.count_if(F.col("close") < F.col("low")) + F.count_if(F.col("close") > F.col("high"))).alias("ohlc_errors"),
    ).where("actual > 0")
    out = out.join(F.broadcast(days)).withColumn("missing_days", F.col("expected_days") - F.col("actual")).withColumn("missing_ratio", F.col("missing_days") / F.col("expected_days"))  # days is one row
    out = out.withColumns({"missing_ratio_pass": F.col("missing_ratio") <= config.MAX_MISSING_RATIO, "ohlc_passed": F.col("ohlc_errors") == 0}).drop("actual", "expected_days")
    out = out.join(gaps, "ticker", "left").na.fill(0, ["large_gaps", "max_gap_days"])
    score = 100 - (F.col("missing_ratio") * 100 * 0.3 + F.col("spike_count") / 10 * 0.2 + F.col("zero_days") * 0.5 + F.col("ohlc_errors") * 5 + F.col("large_gaps") * 2)
    return out.withColumn("has_large_gap", F.col("large_gaps") > 0).withColumn("quality_score", score)


def quality_stats(report: DataFrame) -> DataFrame:
    """One row over all tickers of a quality report."""
    score = F.col("quality_score")
    return report.agg(F.count("*").alias("tickers"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count_if(F.col("missing_ratio_pass") & F.col("ohlc_passed")).alias("passed"))


def symbol_summary(clean_bars: DataFrame) -> DataFrame:
    """Per symbol: days, range, annual return and volatility, last close; without TEST."""
    out = clean_bars.where("ticker != 'TEST'").groupBy(F.col("ticker").alias("symbol")).agg(F.count("*").alias("trading_days"), F.min("date").cast("string").alias("date_start"), F.max("date").cast("string").alias("date_end"), (F.exp(F.sum(F.ln(1 + F.col("return")))) - 1).alias("tr"), F.round(F.coalesce(F.stddev_samp("return") * F.sqrt(F.lit(252.0)), F.lit(0.0)), 4).alias("ann_volatility"), F.round(F.max_by("close", "date"), 2).alias("last_close"))
    return out.withColumn("ann_return", F.round(F.pow(1 + F.col("tr"), 252 / F.col("trading_days")) - 1, 4)).drop("tr")


def universe_summary(clean_bars: DataFrame) -> DataFrame:
    equity = F.product(1 + F.col("return")).over(R.UP_TO_NOW)
    rows = clean_bars.withColumn("equity", equity).withColumn("drawdown", F.col("equity") / F.max("equity").over(R.UP_TO_NOW) - 1)
    out = rows.groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), F.avg("return").alias("m"), F.stddev_samp("return").alias("s"), F.min("drawdown").alias("dd"), F.avg("dollar_volume").alias("adv"))
    return out.select("ticker", "start", "end", "days", F.round(F.pow(1 + F.col("m"), 252) - 1, 4).alias("ann_return"), F.round(F.col("s") * F.sqrt(F.lit(252.0)), 4).alias("ann_vol"), F.round(F.try_divide(F.col("m"), F.col("s")) * F.sqrt(F.lit(252.0)), 3).alias("sharpe"), F.round("dd", 4).alias("max_drawdown"), F.round(F.col("adv") / 1e6, 2).alias("adv_millions"))


def pairs(rows: DataFrame, value: str = "return") -> DataFrame:
    """(t1, t2, cov, corr, n) over the dates both have, t1 <= t2; null correlation without spread."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS)
    spread = lambda s, ss: F.when(ss - s * s / n > ss * 1e-12, ss - s * s / n)  # noqa: E731 (what is left of equal values is rounding)
    made = pair_sums(rows, value).withColumn("s", F.sqrt(spread(sx, sxx)) * F.sqrt(spread(sy, syy))).withColumn("c", F.when(F.col("s").isNull(), 0.0).otherwise(sxy - sx * sy / n))
    return made.select("t1", "t2", n.cast("long").alias("n"), F.when(n > 1, F.col("c") / (n - 1)).alias("cov"), (F.col("c") / F.col("s")).alias("corr"))


def average_pairwise(rows: DataFrame) -> DataFrame:
    """Mean over columns of their mean correlation with the columns before them."""
    by_column = pairs(rows).where("t1 < t2").groupBy("t2").agg(F.avg("corr").alias("m"))
    return by_column.agg(F.avg("m").alias("avg_corr"))


def benchmark(clean_bars: DataFrame) -> DataFrame:
    """Equal-weight mean return by date."""
    return clean_bars.groupBy("date").agg(F.avg("return").alias("bench"))


def benchmark_corr(clean_bars: DataFrame) -> DataFrame:
    both = clean_bars.join(benchmark(clean_bars), "date")
    out = both.groupBy("ticker").agg(F.covar_pop("return", "bench").alias("c"), (F.stddev_pop("return") * F.stddev_pop("bench")).alias("s"))
    return out.select("ticker", F.when(F.col("s") > 0, F.col("c") / F.col("s")).alias("corr"))


def adv(clean_bars: DataFrame, n: int = 20) -> DataFrame:
    return clean_bars.select("date", "ticker", R.mean("dollar_volume", n).alias("adv"))


def covariance(clean_bars: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """(t1, t2, cov), both orders, over the last `window` dates, of tickers with at least `least` rows; empty under two."""
    dates = clean_bars.select("date").distinct().orderBy(F.desc("date")).limit(window)
    recent = clean_bars.join(F.broadcast(dates), "date")
    enough = recent.groupBy("ticker").agg(F.count("return").alias("n")).where(F.col("n") >= least).select("ticker")
    recent = recent.join(F.broadcast(enough), "ticker")
    half = pairs(recent).select("t1", "t2", "cov")
    both = half.unionByName(half.where("t1 != t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "cov"))
    return both.join(F.broadcast(enough.agg(F.count("*").alias("k"))), F.col("k") >= 2).drop("k")



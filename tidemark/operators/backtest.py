"""Vectorised backtests, walk-forward evaluation and performance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import rolling as R
from . import signals as S

YEAR = config.TRADING_DAYS


def _so_far():
    """Of one daily series (some thousand rows a decade), which a single task orders."""
    return Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def positions(signals: DataFrame, window=None) -> DataFrame:
    """A day's position is the signal of the day before, clipped."""
    return signals.withColumn("position", S.clipped(F.lag("signal").over(window or R.TICKER)))


def costs(rows: DataFrame, bps: Column | float = config.SPREAD_BPS, commission: float = config.COMMISSION, window=None) -> DataFrame:
    """cost as a fraction of the position's value: 0 where flat, and on the first day."""
    change = F.abs(F.col("position") - F.lag("position").over(window or R.TICKER))
    total = change * (bps / 1e4 * F.col("close") + commission)
    return rows.withColumn("cost", F.coalesce(F.try_divide(total, F.abs("position") * F.col("close")), F.lit(0.0)))


def strategy(signals: DataFrame, clean_bars: DataFrame) -> DataFrame:
    """(date, ticker, close, position, gross)."""
    rows = positions(signals).join(clean_bars.select("date", "ticker", "close", "return"), ["date", "ticker"])
    return rows.withColumn("gross", F.col("position") * F.col("return"))


def weights_equal(rows: DataFrame) -> DataFrame:
    return rows.select("ticker").distinct().withColumn("weight", 1 / F.count("*").over(Window.partitionBy()))


def weights_inverse_volatility(rows: DataFrame, value: str = "return") -> DataFrame:
    """By the whole sample's volatility (which looks ahead)."""
    v = rows.groupBy("ticker").agg(F.stddev_samp(value).alias("s")).withColumn("inverse", F.when(F.col("s") > 0, 1 / F.col("s")))
    return v.select("ticker", (F.col("inverse") / F.sum("inverse").over(Window.partitionBy())).alias("weight"))


def portfolio(net: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, ret): weighted sum over tickers, null as 0."""
    both = net.join(F.broadcast(weights), "ticker", "left")
    return both.groupBy("date").agg(F.sum(F.coalesce(F.col("net") * F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("ret"))


def daily(signals: DataFrame, clean_bars: DataFrame, weights: DataFrame | None = None, bps: float = config.SPREAD_BPS) -> DataFrame:
    rows = costs(strategy(signals, clean_bars), bps).withColumn("net", F.col("gross") - F.col("cost"))
    return portfolio(rows, weights_equal(signals) if weights is None else weights)


def cost_sensitivity(signals: DataFrame, clean_bars: DataFrame, bps: Sequence[int] = (0, 5, 10, 20)) -> DataFrame:
    """(bps, sharpe) in one job."""
    levels = F.explode(F.array(*(F.lit(float(b)) for b in bps)))
    rows = strategy(signals, clean_bars).withColumn("bps", levels)
    rows = costs(rows, F.col("bps"), window=Window.partitionBy("ticker", "bps").orderBy("date"))
    n = signals.select("ticker").distinct().agg(F.count("*").alias("n"))
    by_day = rows.join(F.broadcast(n)).groupBy("bps", "date").agg(F.sum(F.coalesce((F.col("gross") - F.col("cost")) / F.col("n"), F.lit(0.0))).alias("ret"))
    return by_day.groupBy("bps").agg(sharpe(F.col("ret")).alias("sharpe"))


def equity(returns: DataFrame, capital: float = config.INITIAL_CAPITAL) -> DataFrame:
    """(date, ret, equity, peak, drawdown) of one daily series."""
    rows = returns.withColumn("equity", capital * F.product(1 + F.col("ret")).over(_so_far()))
    rows = rows.withColumn("peak", F.max("equity").over(_so_far()))
    return rows.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def walk_forward(signals: DataFrame, clean_bars: DataFrame, generator: S.Generator | None = None, bps: float | None = None, commission: float = config.COMMISSION) -> DataFrame:
    """(split, date, ret): each split's test window traded by itself, flat on its first day, all splits in one job.

    With bps, spread and commission are taken off.

    generator: from rows (split, part, date, ticker, signal) to those of the test parts with its own signal.
    """
    parts = S.in_splits(signals, S.purged_splits(signals))
    test = (generator or (lambda rows: rows.where("part = 'test'")))(parts).select("split", "date", "ticker", "signal")
    own = Window.partitionBy("split", "ticker").orderBy("date")
    rows = positions(test, own).join(clean_bars.select("date", "ticker", "close", "return"), ["date", "ticker"])
    rows = rows.withColumn("cost", F.lit(0.0)) if bps is None else costs(rows, bps, commission, own)
    n = signals.select("ticker").distinct().agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n)).groupBy("split", "date").agg(F.sum(F.coalesce((F.col("position") * F.col("return") - F.col("cost")) / F.col("n"), F.lit(0.0))).alias("ret"))


def split_sharpes(returns: DataFrame) -> DataFrame:
    """(splits, avg_split_sharpe) of walk_forward()'s rows."""
    by = returns.groupBy("split").agg(sharpe(F.col("ret")).alias("sharpe"))
    return by.agg(F.count("*").alias("splits"), F.avg("sharpe").alias("avg_split_sharpe"))


def text_lines(metrics: DataFrame) -> DataFrame:
    """(n, line): one row of all_metrics() as a short text."""
    shares = ("annual_return", "annual_volatility", "total_return", "max_drawdown", "hit_rate", "best_day", "worst_day")
    ratios = ("sharpe", "sortino", "calmar", "profit_factor")
    lines = [F.format_string("days %d", F.col("num_days").cast("long")), *(F.format_string(f"{c} %.2f%%", F.col(c) * 100) for c in shares), *(F.format_string(f"{c} %.3f", c) for c in ratios)]
    return metrics.select(F.posexplode(F.array(*lines)).alias("n", "line"))


def html_report(metrics: DataFrame) -> DataFrame:
    """(html): the same as one page."""
    rows = text_lines(metrics).select("n", F.concat(F.lit("<li>"), "line", F.lit("</li>")).alias("item"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), "").alias("items")).select(F.concat(F.lit("<html><body><h1>Performance</h1><ul>"), "items", F.lit("</ul></body></html>")).alias("html"))


def sharpe(r: Column, rf: float = config.RISK_FREE_DAILY) -> Column:
    d = F.stddev_samp(r)
    return F.when(d > 0, (F.avg(r) - rf) / d * YEAR**0.5).otherwise(0.0)


def sortino(r: Column, rf: float = config.RISK_FREE_DAILY) -> Column:
    """Infinite without two losses, if the mean is positive."""
    x = r - rf
    down, few = F.stddev_samp(F.when(x < 0, x)), F.count(F.when(x < 0, x)) < 2
    return F.when(few, F.when(F.avg(x) > 0, F.lit(float("inf"))).otherwise(0.0)).when(down > 0, F.avg(x) / down * YEAR**0.5).otherwise(0.0)


def calmar(r: Column, max_drawdown: Column) -> Column:
    annual = F.avg(r) * YEAR
    return F.when(max_drawdown == 0, F.when(annual > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(annual / F.abs(max_drawdown))


def hit_rate(r: Column) -> Column:
    return F.count_if(r > 0) / F.count("*")


def profit_factor(r: Column) -> Column:
    won, lost = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    return F.when(lost > 0, won / lost).otherwise(F.when(won > 0, F.lit(float("inf"))).otherwise(0.0))


def drawdown_duration(returns: DataFrame) -> DataFrame:
    """(duration): the longest recovered drawdown, its days less one; one that hasn't recovered doesn't count."""
    rows = equity(returns, 1.0).withColumn("up", (F.col("drawdown") >= 0).cast("int"))
    runs = rows.withColumn("run", F.sum("up").over(_so_far())).where("up = 0").groupBy("run").agg(F.count("*").alias("n"))
    last = rows.agg(F.sum("up").alias("last"))
    return runs.join(F.broadcast(last)).agg(F.coalesce(F.max(F.when(F.col("run") < F.col("last"), F.col("n") - 1)), F.lit(0)).cast("long").alias("duration"))


def rolling_sharpe(returns: DataFrame, n: int = 60, rf: float = config.RISK_FREE_DAILY) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    d = F.stddev_samp("ret").over(w)
    value = F.when(F.count("ret").over(w) >= n, F.when(d > 0, (F.avg("ret").over(w) - rf) / d * YEAR**0.5).otherwise(0.0))
    return returns.select("date", value.alias("rolling_sharpe")).where("rolling_sharpe is not null")


def monthly(returns: DataFrame) -> DataFrame:
    """(year, month, ret): compounded, months without a day inside the range count 0."""
    months = returns.groupBy(F.trunc("date", "month").alias("m")).agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    spine = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    return spine.join(months, "m", "left").select(F.year("m").alias("year"), F.month("m").alias("month"), F.coalesce("r", F.lit(0.0)).alias("ret"))


def monthly_table(returns: DataFrame) -> DataFrame:
    out = monthly(returns).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return out.select("year", *(F.coalesce(str(m), F.lit(0.0)).alias(f"m{m:02d}") for m in range(1, 13)))


def all_metrics(returns: DataFrame) -> DataFrame:
    rows, r = equity(returns, 1.0), F.col("ret")
    out = rows.agg(
        sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), calmar(r, F.min("drawdown")).alias("calmar"), F.min("drawdown").alias("max_drawdown"), hit_rate(r).alias("hit_rate"), profit_factor(r).alias("profit_factor"),
        (F.avg(r) * YEAR).alias("annual_return"), (F.stddev_samp(r) * YEAR**0.5).alias("annual_volatility"), (F.max_by("equity", "date") - 1).alias("total_return"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"), F.count("*").alias("num_days"),
    )
    return out.join(drawdown_duration(returns)).join(rolling_sharpe(returns).agg(F.max_by("rolling_sharpe", "date").alias("rolling_sharpe_last_60")))

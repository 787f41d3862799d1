"""Technical indicators and alphas per ticker, cross-sectional ranks per date, and the feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.folds import Average, averaged
from . import prices

PER_TICKER = "sma_20 sma_50 ema_20 rsi_14 macd_line macd_signal macd_hist bb_upper_20 bb_mid_20 bb_lower_20 atr_14 alpha_001 alpha_002 alpha_012 price_to_sma_20 volatility_20 volume_ratio_20".split()
MATRIX = [*PER_TICKER, *"cs_rank_returns cs_rank_volatility cs_rank_rsi amihud_illiquidity zscore_returns skewness_returns kurtosis_returns zscore_rsi".split()]


def shown(x: Column, by: str, n: int) -> Column:
    """x from the n-th non-null value of `by` on."""
    return F.when(F.count(by).over(R.UP_TO_NOW) >= n, x)


def ema(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return R.smoothed(df, x, out, 2 / (n + 1)).withColumn(out, shown(F.col(out), x, n))


def seeded(x: str, n: int, first: int) -> Column:
    """What Wilder's average is taken of: null before row `first` (from 0), there the mean of the n values up to it, then x."""
    at = F.row_number().over(R.TICKER) - 1
    return F.when(at == first, F.avg(x).over(R.rows(n))).when(at > first, F.col(x))


def wilder(df: DataFrame, x: str, out: str, n: int, first: int) -> DataFrame:
    """Wilder's average: its seed, then 1/n of each new value."""
    return R.smoothed(df.withColumn(f"{out}_x", seeded(x, n, first)), f"{out}_x", out, 1 / n).drop(f"{out}_x")


def gain() -> Column:
    return F.col("close") - R.lag("close")


def gain_and_loss(d: str) -> dict[str, Column]:
    there = F.col(d).isNotNull()
    return {"__g": F.when(there, F.greatest(d, F.lit(0.0))), "__l": F.when(there, F.greatest(-F.col(d), F.lit(0.0)))}


def strength(gains: str, losses: str) -> Column:
    """RSI of average gains and losses: 100 where there was no loss, even if there was no gain either."""
    value = F.when(F.col(losses) == 0, 100.0).otherwise(100 - 100 / (1 + F.col(gains) / F.when(F.col(losses) > 0, F.col(losses))))
    return F.when(F.col(gains).isNotNull(), value)


def rsi(df: DataFrame, n: int = 14, out: str = "rsi_14") -> DataFrame:
    df = df.withColumn("__d", gain()).withColumns(gain_and_loss("__d"))
    df = wilder(wilder(df, "__g", "__ag", n, n), "__l", "__al", n, n)
    return df.withColumn(out, strength("__ag", "__al")).drop("__d", "__g", "__l", "__ag", "__al")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, "close", fast, "__fast"), "close", slow, "__slow").withColumn("macd_line", F.col("__fast") - F.col("__slow"))
    return ema(df, "macd_line", signal, "macd_signal").withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")).drop("__fast", "__slow")


def true_range() -> Column:
    before = R.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = 14, out: str = "atr_14") -> DataFrame:
    df = wilder(df.withColumn("__tr", true_range()), "__tr", out, n, n - 1)
    return df.withColumn(out, F.when(F.row_number().over(R.TICKER) > n, F.col(out))).drop("__tr")


def bands(n: int = 20, k: float = 2) -> dict[str, Column]:
    mid, d = R.mean("close", n), R.deviation("close", n)
    return {f"bb_upper_{n}": mid + k * d, f"bb_mid_{n}": mid, f"bb_lower_{n}": mid - k * d}


def bollinger(df: DataFrame, n: int = 20, k: float = 2) -> DataFrame:
    return df.withColumns(bands(n, k))


def reversal(x: str) -> Column:
    """The last move of the close against the direction in which x moved."""
    return F.signum((F.col(x) - R.lag(x)).cast("double")) * -(F.col("close") - R.lag("close"))


def alpha_001(df: DataFrame) -> DataFrame:
    return df.withColumn("alpha_001", reversal("return"))


def alpha_012(df: DataFrame) -> DataFrame:
    return df.withColumn("alpha_012", reversal("volume"))


def moves() -> dict[str, Column]:
    """Two-day log volume change and intraday return, rounded to 12 places, so that equal ratios tie whatever the logarithm's last bit."""
    return {"__x": F.round(F.ln("volume") - F.ln(R.lag("volume", 2)), 12), "__y": F.round((F.col("close") - F.col("open")) / F.col("open"), 12)}


def alpha_002_of(rx: str, ry: str, n: int = 6, least: int = 3) -> Column:
    w = R.rows(n)
    spread = F.stddev_pop(rx).over(w) * F.stddev_pop(ry).over(w)
    return F.when((F.count(rx).over(w) >= least) & (spread > 0), -F.covar_pop(rx, ry).over(w) / spread)


def ranked_moves(df: DataFrame) -> DataFrame:
    """df with full-series ranks of its moves; the second is null where the first is."""
    df = df.withColumn("__rx", R.average_rank("__x", "ticker")).withColumn("__ry", R.average_rank("__y", "ticker"))
    return df.withColumn("__ry", F.when(F.col("__rx").isNotNull(), F.col("__ry"))).drop("__x", "__y")


def alpha_002(df: DataFrame, n: int = 6, least: int = 3) -> DataFrame:
    """Minus the rolling correlation of full-series ranks of two-day log volume change and intraday return."""
    return ranked_moves(df.withColumns(moves())).withColumn("alpha_002", alpha_002_of("__rx", "__ry", n, least)).drop("__rx", "__ry")


def features(clean_bars: DataFrame, more: dict[str, Column] | None = None, later: dict[str, Column] | None = None) -> DataFrame:
    """clean_bars with the 17 per-ticker columns; `more` are windows of their columns, `later` windows of the features.

    Windows are asked for together where they can be, as those of one order make one pass: over the bars, over gains and ranges, over
    the ranks' series, and over what the averages gave. All averages are taken in one more.
    """
    first = {"__n": F.row_number().over(R.TICKER), "__d": gain(), "__tr": true_range(), **moves(), **bands(), "alpha_001": reversal("return"), "alpha_012": reversal("volume")}
    first |= {"sma_20": R.mean("close", 20), "sma_50": R.mean("close", 50), "volatility_20": R.deviation("return", 20), "__mv": R.mean("volume", 20)}
    df = clean_bars.withColumns(first | (more or {})).withColumns(gain_and_loss("__d"))
    df = df.withColumns({"__gx": seeded("__g", 14, 14), "__lx": seeded("__l", 14, 14), "__rx14": seeded("__tr", 14, 13)}).drop("__d", "__g", "__l", "__tr")
    df = ranked_moves(df)
    df = averaged(
        df, Average("ema_20", "close", 2 / 21, 20), Average("__fast", "close", 2 / 13, 12), Average("__slow", "close", 2 / 27, 26), Average("macd_signal", ("__fast", "__slow"), 2 / 10, 9),
        Average("__ag", "__gx", 1 / 14), Average("__al", "__lx", 1 / 14), Average("__atr", "__rx14", 1 / 14),
    )
    df = df.withColumns({"macd_line": F.col("__fast") - F.col("__slow"), "rsi_14": strength("__ag", "__al"), "atr_14": F.when(F.col("__n") > 14, F.col("__atr"))})
    df = df.withColumns({"macd_hist": F.col("macd_line") - F.col("macd_signal"), "price_to_sma_20": F.col("close") / F.col("sma_20") - 1, "volume_ratio_20": F.try_divide("volume", "__mv")})
    df = df.withColumns({"alpha_002": alpha_002_of("__rx", "__ry"), **(later or {})})
    return df.drop("__n", "__mv", "__gx", "__lx", "__rx14", "__rx", "__ry", "__fast", "__slow", "__ag", "__al", "__atr")


def cross_ranks(df: DataFrame, made: dict[str, str], universe: DataFrame | None = None) -> DataFrame:
    """For each column and its name in `made`: 2 (rank - 1) / (N - 1) - 1 among the date's tickers, N being all tickers of df or of the universe; 0 for a lone ticker."""
    n = (df if universe is None else universe).select("ticker").distinct().agg(F.count("*").alias("__n"))
    ranks = {out: R.average_rank(x, "date") for x, out in made.items()}
    df = df.withColumns(ranks).join(F.broadcast(n))  # n is one row
    scaled = {out: F.when(F.col(out).isNull(), None).when(F.col("__n") <= 1, 0.0).otherwise(2 * (F.col(out) - 1) / (F.col("__n") - 1) - 1) for out in ranks}
    return df.withColumns(scaled).drop("__n")


def cross_rank(df: DataFrame, x: str, out: str, universe: DataFrame | None = None) -> DataFrame:
    return cross_ranks(df, {x: out}, universe)


def union_volatility(clean_bars: DataFrame, n: int = 20) -> DataFrame:
    """Volatility on the calendar of all tickers: a missing day leaves the next n - 1 without one."""
    return prices.dense(clean_bars, "return").withColumn("uvol", R.deviation("return", n)).select("date", "ticker", "uvol")


def illiquidity() -> Column:
    return F.when(F.col("dollar_volume") != 0, F.abs("return") / (F.col("dollar_volume") + 1e-9))


def amihud(df: DataFrame, n: int = 21, out: str = "amihud_illiquidity") -> DataFrame:
    return df.withColumn("__a", illiquidity()).withColumn(out, R.mean("__a", n)).drop("__a")


def ranked(clean_bars: DataFrame) -> DataFrame:
    """Features with the three cross-sectional ranks and the rolling moments, rows with nulls included."""
    moments = {"amihud_illiquidity": R.mean("__a", 21), "zscore_returns": R.zscore("return", 60), "skewness_returns": R.skewness("return", 60), "kurtosis_returns": R.kurtosis("return", 60)}
    df = features(clean_bars.withColumn("__a", illiquidity()), moments, {"zscore_rsi": R.zscore("rsi_14", 60)}).drop("__a")
    df = df.join(union_volatility(clean_bars), ["date", "ticker"], "left")
    return cross_ranks(df, {"return": "cs_rank_returns", "uvol": "cs_rank_volatility", "rsi_14": "cs_rank_rsi"}, clean_bars)


def matrix(clean_bars: DataFrame) -> DataFrame:
    """(date, ticker) with the 25 features, complete rows only."""
    return ranked(clean_bars).select("date", "ticker", *MATRIX).na.drop(subset=MATRIX)

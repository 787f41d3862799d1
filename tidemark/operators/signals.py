"""Labels, splits, single signals, the composite, its ranking, long/short picks and information coefficients."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import rolling as R
from ..sources.market import written
from . import indicators

HORIZONS = (1, 5, 10, 21)


def forward_returns(bars: DataFrame, horizon: int = 5) -> DataFrame:
    return bars.withColumn("forward_return", F.lead("close", horizon).over(R.TICKER) / F.col("close") - 1)


def barrier_labels(clean_bars: DataFrame, horizon: int = 5, k: float = 1.0) -> DataFrame:
    """1 above k volatilities, -1 below minus that, else 0, also where either is unknown."""
    df = forward_returns(clean_bars, horizon).withColumn("volatility", R.deviation("return", 20))
    up, down = F.col("forward_return") > k * F.col("volatility"), F.col("forward_return") < -k * F.col("volatility")
    return df.withColumn("label", F.when(up, 1).when(down, -1).otherwise(0))


def momentum(cs_rank: Column) -> Column:
    return cs_rank


def rsi_signal(rsi: Column) -> Column:
    return F.when(rsi < 30, 1.0).when(rsi > 70, -1.0).otherwise(0.0)


def ml_signal(probability: Column) -> Column:
    return (probability - 0.5) * 2


def bucket(probability: Column) -> Column:
    return F.when(probability > 0.6, 1).when(probability < 0.4, -1).otherwise(0)


def clipped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def composite(matrix: DataFrame, ml: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(date, ticker, signal): weighted sum of the signals, clipped; without ml the other two count one half each."""
    parts = {"momentum": momentum(F.col("cs_rank_returns")), "rsi": rsi_signal(F.col("rsi_14"))}
    if ml is not None:
        matrix = matrix.join(ml.select("date", "ticker", "signal_probability"), ["date", "ticker"])
        parts["ml"] = ml_signal(F.col("signal_probability"))
    w = weights or dict.fromkeys(parts, 1 / len(parts))
    total = sum((F.lit(w.get(k, 0.0)) * v for k, v in parts.items()), F.lit(0.0))
    return matrix.select("date", "ticker", clipped(total).alias("signal"))


def rank_signals(signals: DataFrame) -> DataFrame:
    n = signals.select("ticker").distinct().agg(F.count("*").alias("n"))
    return signals.withColumn("r", R.average_rank("signal", "date")).join(F.broadcast(n)).select("date", "ticker", (F.try_divide(2 * (F.col("r") - 1), (F.col("n") - 1).cast("double")) - 1).alias("ranked_signal"))


def long_short(ranked: DataFrame, k: int = 2) -> DataFrame:
    """The k highest of each date at +1 and the k lowest at -1 (a ticker may be both when there are few)."""
    top = F.row_number().over(R.DATE.orderBy(F.desc("ranked_signal"), "ticker"))
    low = F.row_number().over(R.DATE.orderBy("ranked_signal", F.desc("ticker")))
    both = ranked.where("ranked_signal is not null")
    return both.withColumn("n", top).where(F.col("n") <= k).drop("n").withColumn("position", F.lit(1)).unionByName(both.withColumn("n", low).where(F.col("n") <= k).drop("n").withColumn("position", F.lit(-1)))


def ic_decay(signals: DataFrame, clean_bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(horizon, n, ic): Spearman correlation pooled over all pairs; null under 10. One plan for all horizons."""
    moves = clean_bars.select("date", "ticker", *((F.lead("close", h).over(R.TICKER) / F.col("close") - 1).alias(f"f{h}") for h in horizons))
    rows = signals.join(moves, ["date", "ticker"]).select("signal", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("f")) for h in horizons)))).where("signal is not null and f is not null")
    rows = written(R.spread_rank(written(rows), "signal", "horizon", "rs"))
    rows = R.spread_rank(rows, "f", "horizon", "rf")
    out = rows.groupBy("horizon").agg(F.count("*").alias("n"), F.covar_pop("rs", "rf").alias("c"), (F.stddev_pop("rs") * F.stddev_pop("rf")).alias("s"))
    return out.select("horizon", "n", F.when((F.col("n") >= 10) & (F.col("s") > 0), F.col("c") / F.col("s")).alias("ic"))


def ordinals(rows: DataFrame) -> DataFrame:
    """(date, i): the dates in order from 0."""
    return rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def splits(n: DataFrame, train: int = config.TRAIN, test: int = config.TEST, step: int = config.STEP, purge: int = 0) -> DataFrame:
    """(split, train_start, train_end, test_start, test_end), ends exclusive, from one row with n dates; purge shortens the train."""
    out = n.where(F.col("n") >= train + test).select("n", F.explode(F.expr(f"sequence(0, cast(floor((n - {train + test}) / {step}) as int))")).alias("split"))
    cut = train - purge if 0 < purge < train else train
    start = F.col("split") * step
    return out.select("split", start.alias("train_start"), (start + cut).alias("train_end"), (start + train).alias("test_start"), (start + train + test).alias("test_end"))


def purged_splits(rows: DataFrame, purge: int = config.PURGE) -> DataFrame:
    return splits(ordinals(rows).agg(F.count("*").cast("int").alias("n")), purge=purge)


def in_splits(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with split and part (train or test): the positional range join, as an equi-join on exploded ordinals."""
    each = parts.select("split", F.explode(F.concat(F.transform(F.sequence("train_start", F.col("train_end") - 1), lambda i: F.struct(i.alias("i"), F.lit("train").alias("part"))), F.transform(F.sequence("test_start", F.col("test_end") - 1), lambda i: F.struct(i.alias("i"), F.lit("test").alias("part"))))).alias("e"))
    dates = each.select("split", "e.i", "e.part").join(ordinals(rows), "i")
    return rows.join(dates, "date")


def random_signals(rows: DataFrame, seed: int = 42) -> DataFrame:
    return rows.select("date", "ticker", (F.rand(seed) * 2 - 1).alias("signal"))


def boosted(x, y, z, rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 16):
    """Gradient-boosted trees on binned features for classes 0 to 2: probabilities of the rows of z, and each feature's share of the gain.

    Every round grows a tree a class on the gradients of the log loss, level by level from histograms of all nodes at once.
    """
    import numpy as np

    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    asked = np.stack([np.searchsorted(e, z[:, j]) for j, e in enumerate(edges)], 1)
    scores, out, gains = np.zeros((n, 3)), np.zeros((len(z), 3)), np.zeros(k)
    cell = binned + np.arange(k) * bins
    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(3):
            g, h = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
            node, there = np.zeros(n, int), np.zeros(len(z), int)
            for level in range(depth):
                at = (node[:, None] * (k * bins) + cell).ravel()
                left = [np.bincount(at, np.repeat(v, k), 2**level * k * bins).reshape(-1, k, bins).cumsum(2) for v in (g, h)]
                (gl, hl), (gt, ht) = left, (v[:, :, -1:] for v in left)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                best = gain.reshape(len(gain), -1).argmax(1)
                np.add.at(gains, best // bins, gain.reshape(len(gain), -1)[np.arange(len(best)), best])
                feature, cut = best // bins, best % bins
                node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
                there = 2 * there + (asked[np.arange(len(z)), feature[there]] > cut[there])
            leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + 1)
            scores[:, c] += leaf[node]
            out[:, c] += leaf[there]
    p = np.exp(out - out.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), gains / max(gains.sum(), 1e-12)


def _trained(matrix: DataFrame, clean_bars: DataFrame, purge: int, made: Callable, schema: str) -> DataFrame:
    """made(test rows, probabilities, importances) of the model of every ticker and split: one job, a task a (ticker, split)."""
    rows = written(matrix.join(barrier_labels(clean_bars).select("date", "ticker", "label"), ["date", "ticker"]))
    features = indicators.MATRIX

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        train, test = part[part.part == "train"], part[part.part == "test"]
        if len(train) < 50 or not len(test):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        p, gains = boosted(train[features].to_numpy(float), train.label.to_numpy() + 1, test[features].to_numpy(float))
        return made(test, p, gains)

    return in_splits(rows, purged_splits(rows, purge)).groupBy("ticker", "split").applyInPandas(fit, schema)


def walk_forward_ml(matrix: DataFrame, clean_bars: DataFrame, purge: int = config.PURGE) -> DataFrame:
    """Out-of-sample class probabilities for every ticker and split.

    signal_probability is the second class's, as the classes sort (-1, 0, 1); p_buy is the buy class's.
    """
    made = lambda test, p, _: test[["date", "ticker", "split"]].assign(p_sell=p[:, 0], p_neutral=p[:, 1], p_buy=p[:, 2])
    out = _trained(matrix, clean_bars, purge, made, "date date, ticker string, split int, p_sell double, p_neutral double, p_buy double")
    p = F.col("p_neutral")
    return out.select("date", "ticker", "split", "p_buy", p.alias("signal_probability"), bucket(p).alias("signal"))


def importances(matrix: DataFrame, clean_bars: DataFrame, purge: int = config.PURGE) -> DataFrame:
    """(ticker, split, feature, importance): each feature's share of a model's gain."""
    made = lambda test, _, gains: pd.DataFrame({"ticker": test.ticker.iloc[0], "split": test.split.iloc[0], "feature": indicators.MATRIX, "importance": gains})
    return _trained(matrix, clean_bars, purge, made, "ticker string, split int, feature string, importance double")


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k features of the largest mean importance over all models."""
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(k)


def read_signals(signals: DataFrame, ticker: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    for value, test in ((ticker, F.col("ticker") == ticker), (first, F.col("date") >= first), (last, F.col("date") <= last)):
        if value is not None:
            signals = signals.where(test)
    return signals


Generator = Callable[[DataFrame], DataFrame]

"""Averages in one pass, features taken together and the quality report in one pass, against the operators one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.folds import Average, averaged
from tidemark.operators import indicators as I
from tidemark.operators import prices as P
from tidemark.sources.market import written

BARS = "date date, ticker string, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    """Three tickers, one too short for any feature; null closes, days without volume, a spike, equal rows of moves, missing days."""
    rng, rows = random.Random(3), []
    for ticker, n in (("A", 160), ("A A", 140), ("short", 9)):
        close = 50.0
        for day in range(n):
            if day % 29 == 7:
                continue
            close = close * (1.4 if day == 100 else 1) * (1 + rng.choice([-0.02, -0.01, 0.0, 0.0, 0.01, 0.015]))
            rows.append((day, ticker, close - 0.5, close + 1, close - 1 if day % 50 else close + 2, None if day % 31 == 5 else close, 0 if day % 37 == 9 else 100_000 + rng.randrange(3) * 50_000))
    return spark.createDataFrame(rows, BARS.replace("date date", "day int")).select(F.date_add(F.lit("2022-01-03").cast("date"), "day").alias("date"), "*").drop("day").repartition(5).cache()


def recursion(xs, alpha, least=1):
    e, seen, out = None, 0, []
    for x in xs:
        if x is not None:
            e, seen = x if e is None else alpha * x + (1 - alpha) * e, seen + 1
        out.append(e if x is not None and seen >= least else None)
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_averages_equal_the_recursion_whatever_the_batches(spark, bars, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = averaged(bars, Average("a", "close", 0.1), Average("b", "close", 0.3, 12), Average("c", ("a", "b"), 0.2, 4)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == bars.count()
    for ticker in ("A", "A A", "short"):
        rows = sorted((r for r in got if r.ticker == ticker), key=lambda r: r.date)
        a, b = recursion([r.close for r in rows], 0.1), recursion([r.close for r in rows], 0.3, 12)
        c = recursion([None if x is None or y is None else x - y for x, y in zip(a, b, strict=True)], 0.2, 4)
        for r, *want in zip(rows, a, b, c, strict=True):
            assert [r.a, r.b, r.c] == [None if w is None else pytest.approx(w, rel=1e-12, abs=1e-12) for w in want], (ticker, r.date)


def test_averages_of_nan_nulls_and_other_types(spark):
    rows = [(1, "x", math.nan, [1]), (2, "x", 4.0, None), (3, "x", None, [2]), (4, "x", 8.0, []), (1, None, 3.0, None), (2, None, 5.0, None)]
    df = spark.createDataFrame(rows, "date int, ticker string, `a value` double, more array<int>")
    got = {(r.ticker, r.date): (r.e, r.more) for r in averaged(df, Average("e", "a value", 0.5)).collect()}
    assert got == {("x", 1): (None, [1]), ("x", 2): (4.0, None), ("x", 3): (None, [2]), ("x", 4): (6.0, []), (None, 1): (3.0, None), (None, 2): (4.0, None)}
    assert averaged(df.limit(0), Average("e", "a value", 0.5)).collect() == []


def test_features_equal_each_indicator(bars):
    clean = P.clean(bars)
    got = {(r.ticker, r.date): r for r in I.features(clean).collect()}
    alone = [(I.ema(clean, "close", 20, "ema_20"), ["ema_20"]), (I.rsi(clean), ["rsi_14"]), (I.macd(clean), ["macd_line", "macd_signal", "macd_hist"]), (I.atr(clean), ["atr_14"])]
    alone += [(I.bollinger(clean), ["bb_upper_20", "bb_mid_20", "bb_lower_20"]), (I.alpha_001(clean), ["alpha_001"]), (I.alpha_002(clean), ["alpha_002"]), (I.alpha_012(clean), ["alpha_012"])]
    for df, columns in alone:
        rows = df.select("ticker", "date", *columns).collect()
        assert len(rows) == len(got) and any(r[columns[0]] is not None for r in rows)
        for r in rows:
            for c in columns:
                assert got[r.ticker, r.date][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-9)), (r.ticker, r.date, c)
    assert set(clean.columns) | set(I.PER_TICKER) == set(I.features(clean).columns)


def test_few_windows(bars):
    plan = I.matrix(written(P.clean(bars)))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line for line in plan.splitlines()) < 15


def test_report_equals_each_check(bars):
    got = {r.ticker: r for r in P.quality_report(bars).collect()}
    spikes = {r.ticker: r for r in P.return_spikes(P.clean(bars)).collect()}
    missing, zero, sane = ({r.ticker: r for r in df.collect()} for df in (P.missing_bars(bars), P.zero_volume(bars), P.ohlc_sanity(bars)))
    assert got.keys() == missing.keys() and sum(r.spike_count for r in got.values()) > 0
    for t, r in got.items():
        assert (r.missing_days, r.missing_ratio, r.missing_ratio_pass) == (missing[t].missing_days, missing[t].missing_ratio, missing[t].passed)
        assert (r.zero_days, r.zero_ratio, r.ohlc_errors, r.ohlc_passed) == (zero[t].zero_days, zero[t].zero_ratio, sane[t].errors, sane[t].passed)
        s = spikes.get(t)
        assert (r.spike_count, r.max_return, r.min_return) == ((s.spike_count, s.max_return, s.min_return) if s else (0, 0.0, 0.0))

"""Covariances by tiles against pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import products
from tidemark.operators import prices

SCHEMA = "date date, ticker string, return double"


@pytest.fixture(scope="module")
def series():
    """23 tickers on 90 days: holes, NaN, nulls, an infinite value, a constant series, one that is constant where another is, one seen once."""
    rng = np.random.default_rng(5)
    days = pd.date_range("2021-01-01", periods=90).date
    rows = [(d, f"T{t:02d}", float(rng.normal(0.3, 0.01))) for t in range(18) for d in days if rng.random() < 0.8]
    rows += [(d, "nan", math.nan if n % 3 == 0 else float(n)) for n, d in enumerate(days)]
    rows += [(d, "infinite", math.inf if n == 4 else float(n % 7)) for n, d in enumerate(days)]
    rows += [(d, "null", None if n % 2 else float(n % 5)) for n, d in enumerate(days)]
    rows += [(d, "flat", 0.1) for d in days] + [(d, "half", 0.1 if n < 45 else float(n)) for n, d in enumerate(days)] + [(d, "early", float(n)) for n, d in enumerate(days) if n < 45]
    return [*rows, (days[7], "once", 1.5), (None, "T00", 0.5), (days[0], None, 0.5)]


def expected(series):
    wide = pd.DataFrame([r for r in series if r[0] is not None and r[1] is not None], columns=["date", "ticker", "x"]).replace([math.inf], math.nan).pivot(index="date", columns="ticker", values="x")
    out = {}
    for a in wide:
        for b in wide:
            both = wide[[a]].assign(other=wide[b]).dropna()
            if a <= b and len(both):
                x, y = both[a].to_numpy(), both["other"].to_numpy()
                spread = x.min() < x.max() and y.min() < y.max()
                out[a, b] = (len(both), np.cov(x, y)[0, 1] if len(both) > 1 else None, np.corrcoef(x, y)[0, 1] if spread else None)
    return out


@pytest.mark.parametrize(("block", "chunk"), [(256, 256), (4, 7), (1, 1000)])
def test_pairs_equal_pandas(spark, series, monkeypatch, block, chunk):
    plain = products.pair_sums
    monkeypatch.setattr(prices, "pair_sums", lambda rows, value: plain(rows, value, block, chunk))
    got = {(r.t1, r.t2): (r.n, r["cov"], r["corr"]) for r in prices.pairs(spark.createDataFrame(series, SCHEMA)).collect()}
    want = expected(series)
    assert got.keys() == want.keys()
    for pair, (n, cov, corr) in want.items():
        assert got[pair][0] == n
        assert got[pair][1] == (None if cov is None else pytest.approx(cov, rel=1e-9, abs=1e-15)), pair
        assert got[pair][2] == (None if corr is None else pytest.approx(corr, rel=1e-9, abs=1e-9)), pair


def test_no_row_for_a_pair_and_a_date(spark, series):
    """A row is sent once to each block of tickers: here to one."""
    df = prices.pairs(spark.createDataFrame(series, SCHEMA))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    assert "(date" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_pairs_of_nothing(spark):
    assert prices.pairs(spark.createDataFrame([], SCHEMA)).collect() == []

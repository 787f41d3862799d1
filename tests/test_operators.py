"""Small hand-made cases: recursions against loops, latches, ties, null runs, truncation."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import backtest as B
from tidemark.operators import execution as X
from tidemark.operators import indicators as I
from tidemark.operators import prices as P
from tidemark.operators import risk as K
from tidemark.operators import signals as S
from tidemark.sources import market as M
from tidemark.streaming import quotes as Q

DAY = dt.date(2024, 1, 1)


def series(spark, closes, ticker="A", volume=1_000_000):
    rows = [(DAY + dt.timedelta(i), ticker, c, c, c, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long")


def test_smoothing_equals_a_loop_across_blocks(spark):
    """A decay so fast that blocks are short: the carry between them is exercised."""
    xs = [math.sin(i) * 10 + 50 for i in range(1500)]
    got = [r.e for r in R.smoothed(series(spark, xs), "close", "e", 0.6).orderBy("date").collect()]
    e, want = xs[0], [xs[0]]
    for x in xs[1:]:
        e = 0.6 * x + 0.4 * e
        want.append(e)
    assert got == pytest.approx(want, rel=1e-12)


def test_rsi_is_100_on_flat_prices_and_needs_a_full_window(spark):
    got = [r.rsi_14 for r in I.rsi(series(spark, [5.0] * 20)).orderBy("date").collect()]
    assert got[:14] == [None] * 14 and set(got[14:]) == {100.0}


def test_fill_reaches_three_rows_only(spark):
    closes = [1.0, None, None, None, None, 2.0, 3.0]
    got = {r.date.day: r.close for r in P.clean(series(spark, closes)).collect()}
    assert got == {2: 1.0, 3: 1.0, 4: 1.0, 6: 2.0, 7: 3.0}


def test_features_do_not_look_ahead_but_alpha_002_does(spark):
    import random

    random.seed(3)
    closes = [100.0]
    for _ in range(120):
        closes.append(closes[-1] * (1 + random.uniform(-0.03, 0.03)))
    whole = P.clean(series(spark, closes).withColumn("volume", (F.col("close") * 1000).cast("long")).withColumn("open", F.col("close") * (1 + F.sin("close") / 100)))
    cut = whole.where(F.col("date") <= DAY + dt.timedelta(80))
    a = {r.date: r for r in I.features(whole).collect()}
    b = {r.date: r for r in I.features(cut).collect()}
    own = [c for c in I.PER_TICKER if c != "alpha_002"]
    assert all(a[d][c] == pytest.approx(b[d][c], rel=1e-9, abs=1e-12) if b[d][c] is not None else a[d][c] is None for d in b for c in own)
    assert any(a[d]["alpha_002"] != b[d]["alpha_002"] for d in b if b[d]["alpha_002"] is not None)


def test_ranks_share_ties_and_a_lone_ticker_is_zero(spark):
    rows = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "B", 1.0), (DAY, "C", 3.0), (DAY, "D", None)], "date date, ticker string, x double")
    assert {r.ticker: r.r for r in I.cross_rank(rows, "x", "r").collect()} == {"A": pytest.approx(-2 / 3), "B": pytest.approx(-2 / 3), "C": pytest.approx(1 / 3), "D": None}
    assert I.cross_rank(rows.where("ticker = 'A'"), "x", "r").first().r == 0


def test_long_short_overlaps_when_there_are_few(spark):
    rows = spark.createDataFrame([(DAY, t, v) for t, v in (("A", 1.0), ("B", 0.0), ("C", -1.0))], "date date, ticker string, ranked_signal double")
    got = {(r.ticker, r.position) for r in S.long_short(rows).collect()}
    assert got == {("A", 1), ("B", 1), ("B", -1), ("C", -1)}


def test_breaker_is_strict_latches_and_keeps_its_peak(spark):
    navs = [1000.0, 950.0, 949.0, 990.0, 990.0, 940.0]
    rows = spark.createDataFrame([(DAY + dt.timedelta(i), v, i == 4) for i, v in enumerate(navs)], "date date, nav double, reset boolean")
    assert [r.halted for r in K.breaker(rows).orderBy("date").collect()] == [False, False, True, True, False, True]


def test_metrics_without_losses_are_infinite(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(i), 0.01 * (i + 1)) for i in range(5)], "date date, ret double")
    got = rows.agg(B.sortino(F.col("ret")).alias("s"), B.profit_factor(F.col("ret")).alias("p")).first()
    assert got.s == math.inf and got.p == math.inf


def test_profit_factor_and_drawdown_of_known_series(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(i), r) for i, r in enumerate((0.1, -0.05, -0.05, 0.2, -0.1))], "date date, ret double")
    assert rows.agg(B.profit_factor(F.col("ret")).alias("p")).first().p == pytest.approx(0.3 / 0.2)
    assert B.drawdown_duration(rows).first().duration == 1  # the last one hasn't recovered


def test_impact_falls_back_without_volume(spark):
    row = spark.createDataFrame([("SELL", 20000, 0.0, 0.01), ("SELL", 100, 10000.0, 0.02), ("BUY", 100, 10000.0, 0.0)], "side string, q long, adv double, sigma double")
    got = [r[0] for r in row.select(X.impact(F.col("side"), F.col("q"), F.col("adv"), F.col("sigma"))).collect()]
    assert got == pytest.approx([0.002, -0.002, 0.002])


def test_routed_orders_move_weights_by_the_execution_price_and_halt(spark):
    rows = [("P", DAY, 1, "X", "BUY", 400, False), ("P", DAY, 2, "X", "BUY", 50, False), ("P", DAY, 3, "X", "SELL", 1, True), ("P", DAY, 4, "X", "SELL", 1, None)]
    orders = spark.createDataFrame(rows, "portfolio string, date date, l_orderkey long, symbol string, side string, quantity long, halted boolean")
    orders = orders.selectExpr("*", "1 AS l_linenumber", "1L AS l_partkey", "1L AS l_suppkey", "100D AS price", "400D AS adv", "0.2D AS sigma")
    got = X.route(orders, [("X", "X", 1e-8)], {}).orderBy("l_orderkey").collect()
    # the first fill costs 120 a share: a weight of 0.048, so that 0.005 more is beyond the limit
    assert [r.status for r in got] == ["FILLED", "STOCK_LIMIT", "CIRCUIT_BREAKER", "FILLED"]
    assert (got[0].fill_price, got[0].commission, got[0].slippage_bps) == pytest.approx((120, 2, 200))
    assert got[3].slippage_bps == pytest.approx(-10) and got[1].commission is None and got[2].fill_price is None


def test_quotes_with_crossed_or_missing_sides_go(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.5), (2, 2.0, 1.5), (3, None, 1.0), (4, 0.0, 1.0)], "event_id long, bid double, ask double")
    assert [r.event_id for r in Q.valid(rows).collect()] == [1]


@pytest.mark.parametrize("bound", [{}, {"run_rows": 7000}])
def test_stream_latch_orders_the_whole_batch(spark, tmp_path, bound):
    """Over 10,000 shuffled rows a portfolio (more than Spark hands over at once), in several files, against the batch breaker."""
    at = F.col("id")
    nav = spark.range(50_000).select(F.element_at(F.array(F.lit("A"), F.lit("B")), (at % 2 + 1).cast("int")).alias("portfolio"), at.alias("at"), (1000 + at / 100 + F.sin(at / 300) * (at % 4000) / 40).alias("nav"), (at % 971 == 0).alias("reset"))
    nav.orderBy(F.xxhash64("at")).repartition(7).write.parquet(f"{tmp_path}/nav")
    name = f"latch{len(bound)}"
    got = Q.drained(Q.latch(spark.readStream.schema(nav.schema).parquet(f"{tmp_path}/nav"), **bound), name)
    for p in "AB":
        want = K.breaker(nav.where(F.col("portfolio") == p).withColumnRenamed("at", "date")).select("date", "nav", "drawdown", "halted")
        mine = got.where(F.col("portfolio") == p).select("at", "nav", "drawdown", "halted")
        assert want.where("halted").count() > 100 and mine.count() == 25_000
        assert mine.exceptAll(want).count() == 0


def test_stream_latch_keeps_nulls_and_orders_ties(spark, tmp_path):
    rows = [(None, 1, 1000.0, False), (None, 2, None, None), ("A", 5, 900.0, True), ("A", 5, 900.0, False), ("A", 4, 1000.0, False), ("A", None, 2000.0, None)]
    df = spark.createDataFrame(rows, "portfolio string, at long, nav double, reset boolean")
    df.write.parquet(f"{tmp_path}/nav")
    got = {(r.portfolio, r.at, r.nav, r.halted) for r in Q.drained(Q.latch(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/nav"), run_rows=2), "latch_ties").collect()}
    assert got == {(None, 1, 1000.0, False), (None, 2, None, False), ("A", 4, 1000.0, False), ("A", 5, 900.0, True), ("A", 5, 900.0, False), ("A", None, 2000.0, False)}


def test_empty_bars_give_empty_results(spark):
    none = series(spark, [])
    for df in (P.clean(none), P.validate(none), P.missing_bars(none), P.price_gaps(none), I.matrix(P.clean(none))):
        assert df.count() == 0


def test_spread_rank_equals_the_window(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(37)).cast("double").alias("x"))
    got = R.spread_rank(rows, "x", "g", "r", 8).withColumn("w", R.average_rank("x", "g")).where("r != w")
    assert got.count() == 0


def test_boosted_trees_learn_and_name_the_feature():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = np.digitize(x[:, 3] * x[:, 3], [0.3, 1.2])
    p, gains = S.boosted(x[:400], y[:400], x[400:])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y[400:]).mean() > 0.85
    assert gains.argmax() == 3 and gains[3] > 0.7


def test_walk_forward_takes_a_generator_and_costs(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(400)]
    rows = spark.createDataFrame([(d, t, (-1.0) ** i, 100.0, 0.01) for i, d in enumerate(days) for t in "AB"], "date date, ticker string, signal double, close double, `return` double")
    plain, costly = B.walk_forward(rows, rows), B.walk_forward(rows, rows, bps=10.0)
    mine = B.walk_forward(rows, rows, lambda parts: parts.where("part = 'test'").withColumn("signal", F.lit(1.0)))
    total = lambda df: df.agg(F.sum("ret")).first()[0]
    assert total(costly) < total(plain)
    assert total(mine) == pytest.approx(0.01 * (mine.count() - mine.select("split").distinct().count()))
    assert B.split_sharpes(plain).first().splits == plain.select("split").distinct().count()


def test_reports(spark):
    days = [(dt.date(2020, 1, 1) + dt.timedelta(i), 0.01 * (-1) ** i + 0.001) for i in range(100)]
    metrics = B.all_metrics(spark.createDataFrame(days, "date date, ret double"))
    lines = [r.line for r in B.text_lines(metrics).orderBy("n").collect()]
    assert lines[0] == "days 100" and "hit_rate 50.00%" in lines
    page = B.html_report(metrics).first().html
    assert all(f"<li>{x}</li>" in page for x in lines)


def test_source_rows_are_normalised(spark, tmp_path):
    """Open to volume alone is kept; a row without any price goes, whatever its volume."""
    raw = spark.createDataFrame([("2020-01-02 00:00:00-05:00", 1.0, 9.0, 5), ("2020-01-03 00:00:00-05:00", None, 9.0, 7), ("2020-01-06 00:00:00-05:00", 2.0, 9.0, None)], "Date string, Close double, `Adj Close` double, Volume long")
    got = M.normalised(raw)
    assert got.columns == ["date", "close", "volume"]
    assert [tuple(r) for r in got.collect()] == [(dt.date(2020, 1, 2), 1.0, 5), (dt.date(2020, 1, 6), 2.0, 0)]
    raw.write.option("header", True).csv(str(tmp_path / "AAA"))
    rows, report = M.universe(spark, {"AAA": str(tmp_path / "AAA"), "BBB": str(tmp_path / "BBB")}, "Date string, Close double, `Adj Close` double, Volume long")
    assert rows.count() == 2 and {tuple(r) for r in report.collect()} == {("AAA", False), ("BBB", True)}


def test_sinks_caches_and_events(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []
    make = lambda: calls.append(1) or spark.range(3)
    assert M.cached(spark, path, make).count() == M.cached(spark, path, make).count() == 3 and len(calls) == 1
    assert M.cached(spark, path, make, force=True).count() == 3 and len(calls) == 2
    for _ in range(2):
        M.append_csv(spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "csv"))
    assert M.read_csv(spark, str(tmp_path / "csv"), "i int, s string").count() == 2
    nav = spark.createDataFrame([(dt.date(2020, 1, i), v, False) for i, v in ((1, 100.0), (2, 90.0), (3, 99.0))], "date date, nav double, reset boolean")
    events = K.risk_events(K.breaker(nav))
    assert [r.details["nav"] for r in K.filtered(events, "CIRCUIT_BREAKER_TRIGGERED").collect()] == ["90.0"]
    assert K.filtered(events, since="2020-01-03").count() == 0
    signals = spark.createDataFrame([(dt.date(2020, 1, 1), "A"), (dt.date(2020, 1, 2), "B")], "date date, ticker string")
    assert S.read_signals(signals, ticker="A").count() == S.read_signals(signals, first="2020-01-02").count() == 1


def test_quote_upsert_stream(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    quotes = lambda *bids: spark.createDataFrame([(t + dt.timedelta(seconds=i), "A", b) for i, b in bids], "time timestamp, symbol string, bid double")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for state, rows in ((1, [(0, 1.0), (1, 2.0)]), (1, [(1, 9.0), (2, 3.0)]), (2, [])):  # the second state replays everything
        if rows:
            quotes(*rows).write.mode("append").parquet(source)
        Q.upserted(spark.readStream.schema("time timestamp, symbol string, bid double").parquet(source), out, str(tmp_path / f"state{state}"), every=None).awaitTermination()
    assert sorted(r.bid for r in spark.read.parquet(out).collect()) == [1.0, 2.0, 3.0]
    query = Q.upserted(spark.readStream.schema("time timestamp, symbol string, bid double").parquet(source), out, str(tmp_path / "state3"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_routing_equals_brute_force_over_every_gate(spark, seed):
    """Weights and the whole quadratic form rebuilt for each order, in plain loops."""
    import random

    draw = random.Random(seed)
    names, sectors = [f"S{i}" for i in range(12)], {f"S{i}": "West" if i < 8 else "East" for i in range(10)}
    root = [[draw.gauss(0, 0.006) for _ in range(4)] for _ in names]
    s = {(a, b): sum(x * y for x, y in zip(root[i], root[j], strict=True)) for i, a in enumerate(names) for j, b in enumerate(names)}
    rows = []
    for p in ("P", "Q", None):
        for k in range(400):
            rows.append((p, DAY + dt.timedelta(draw.randrange(90)), k, draw.choice([*names, "NEW"]), draw.choice(["BUY", "BUY", "SELL"]), draw.choice([10, 100, 300, 6000]), 100.0, draw.choice([None, 0.0, 1e5, 1e6]), draw.choice([None, 0.02, 0.01]), draw.choice([False, False, False, None, True])))
    want, weights = {}, {}
    for p, day, k, symbol, side, quantity, price, adv, sigma, halted in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        w = weights.setdefault(p, {})
        d = quantity * price / 1e6
        new = {**w, symbol: w.get(symbol, 0.0) + (d if side == "BUY" else -d)}
        total = sum(new.values())
        sigma_p = math.sqrt(max(0.0, sum(new[a] * new[b] * s[a, b] for a in new for b in new if (a, b) in s)))
        mine = sectors.get(symbol, "Other")
        if side == "BUY" and quantity * price > 5e5:
            status = "ORDER_VALUE"
        elif symbol == "NEW":
            status = "NO_COVARIANCE"
        elif new[symbol] < 0:
            status = "SELL_EXCEEDS_HOLDING"
        elif total > 0 and K.config.Z95 * sigma_p / total > 0.02:
            status = "VAR_LIMIT"
        elif halted:
            status = "CIRCUIT_BREAKER"
        elif w.get(symbol, 0.0) + d > 0.05:
            status = "STOCK_LIMIT"
        elif mine != "Other" and sum(x for t, x in w.items() if sectors.get(t, "Other") == mine) + d > 0.25:
            status = "SECTOR_LIMIT"
        else:
            status = "FILLED"
            move = 0.001 * quantity / 10000 if not adv else (sigma or 0.02) * math.sqrt(quantity / adv) * (1 if side == "BUY" else -1)
            w[symbol] = w.get(symbol, 0.0) + quantity * price * (1 + move) / 1e6 * (1 if side == "BUY" else -1)
        want[p, k] = status
    orders = spark.createDataFrame(rows, "portfolio string, date date, l_orderkey long, symbol string, side string, quantity long, price double, adv double, sigma double, halted boolean").selectExpr("*", "1 AS l_linenumber", "1L AS l_partkey", "1L AS l_suppkey")
    got = {(r.portfolio, r.l_orderkey): r.status for r in X.route(orders.repartition(7), [(a, b, c) for (a, b), c in s.items()], sectors).collect()}
    assert got == want
    assert len(set(want.values())) >= 7


def test_forest_is_as_good_as_the_boosted_trees(spark):
    import numpy as np

    from tidemark.operators import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = np.digitize(x[:, 3] * x[:, 3], [0.9, 2.5])  # uneven classes
    names = [f"f{j}" for j in range(5)]
    rows = spark.createDataFrame([(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], f"i int, {', '.join(f'{n} double' for n in names)}, label double")
    train = models.balanced(rows.where("i < 1000"))
    weights = {r.label: r.w for r in train.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert len(weights) == 3 and all(w == pytest.approx(1000 / 3) for w in weights.values())
    model = models.fitted(train, names)
    p = np.array([[r.p_sell, r.p_neutral, r.p_buy] for r in models.predicted(model, rows.where("i >= 1000")).orderBy("i").collect()])
    boosted, _ = S.boosted(x[:1000], y[:1000], x[1000:])
    each = lambda q: np.mean([(q.argmax(1) == c)[y[1000:] == c].mean() for c in range(3)])  # noqa: E731  accuracy of classes, alike
    assert np.allclose(p.sum(1), 1) and each(p) >= each(boosted)
    assert max(models.importances(model, names), key=lambda f: f[1])[0] == "f3"


def test_walk_forward_signals_are_a_table_that_is_taken_up_again(spark, tmp_path):
    import random

    from tidemark.operators import models

    draw, rows = random.Random(2), []
    for t in "AB":
        close = 100.0
        for i in range(400):
            close *= 1 + draw.uniform(-0.02, 0.021)
            rows.append((DAY + dt.timedelta(i), t, close, draw.random(), draw.random()))
    bars = spark.createDataFrame(rows, "date date, ticker string, close double, cs_rank_returns double, rsi_14 double").withColumn("return", F.col("close") / F.lag("close").over(R.TICKER) - 1)
    log = models.signal_log(spark, str(tmp_path / "signals"))
    features = ["cs_rank_returns", "rsi_14"]
    got = models.walk_forward(bars.select("date", "ticker", *features), bars, log, features=features, trees=3, depth=2)
    n = got.count()
    assert n == 2 * 63 * got.select("split").distinct().count() and got.where("abs(p_sell + p_neutral + p_buy - 1) > 1e-9 or signal_probability != p_neutral").count() == 0
    at = {r.run: r.attempt for r in log.commits().collect()}
    assert models.walk_forward(bars.select("date", "ticker", *features), bars, log, features=features).count() == n
    assert {r.run: r.attempt for r in log.commits().collect()} == at
    assert models.importances_of(log).groupBy("split").agg(F.sum("importance").alias("s")).where("abs(s - 1) > 1e-9 and s != 0").count() == 0
    three = S.composite(bars, got)
    assert three.count() == n and three.where("signal is null or abs(signal) > 1").count() == 0


def test_look_ahead_names_the_feature_that_looks(spark):
    from tidemark.operators.audit import look_ahead

    rows = series(spark, [50 + 10 * math.sin(i) for i in range(60)]).unionByName(series(spark, [5.0 + i for i in range(60)], "B"))
    made = lambda df: df.withColumn("past", F.lag("close").over(R.TICKER)).withColumn("future", F.lead("close", 2).over(R.TICKER)).withColumn("rank", F.percent_rank().over(R.TICKER_ALL.orderBy("close")) if hasattr(R, "TICKER_ALL") else F.avg("close").over(Window.partitionBy("ticker")))
    got = {r.feature: (r.compared, r.changed) for r in look_ahead(rows, made, ["past", "future", "rank", "volume"]).collect()}
    assert got["past"][1] == got["volume"][1] == 0 and got["rank"][1] == got["rank"][0] == 2 * (15 + 30 + 45)
    assert got["future"][1] == 2 * 2 * 3


def test_walk_forward_adds_few_jobs_to_those_of_its_forests(spark, tmp_path):
    from tidemark.operators import models

    def jobs(what):
        sc, group = spark.sparkContext, f"jobs-{dt.datetime.now().timestamp()}"
        sc.setJobGroup(group, group)
        try:
            return what(), len(sc.statusTracker().getJobIdsForGroup(group))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    rows = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(20)], "i int, label double")
    got, n = jobs(lambda: models.balanced(rows, counts={0.0: 15, 1.0: 5}))  # counts that are known aren't taken again
    assert n == 0 and sorted(got.collect()) == sorted(models.balanced(rows).collect())
    log = models.signal_log(spark, str(tmp_path / "signals"))
    for k in range(3):
        new, n = jobs(lambda k=k: log.append(spark.range(1).select(F.lit("f").alias("feature"), F.lit(0.5 * k).alias("importance")), f"importance-{k}"))
        assert new and n <= 3  # two to know the log's schemas, one that writes
    assert log.commits().where("at > current_timestamp() - interval 1 hour and at <= current_timestamp()").count() == 3
    assert models.importances_of(log).agg(F.sum("importance")).first()[0] == 1.5

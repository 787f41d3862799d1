"""Data sources, repeatable sinks and the stateful breaker: pruning is asserted from plans, repeats and restarts from rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prices as P
from tidemark.operators import risk as K
from tidemark.sources import feed, market, store
from tidemark.streaming import breaker

DAY = dt.date(2024, 1, 1)


def bars(spark, tickers=("A", "AA", "B C"), days=30):
    rows = [(DAY + dt.timedelta(i), t, 1.0 + i, 3.0 + i, 0.5 + i, 2.0 + i, 1000 + i) for t in tickers for i in range(days)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long")


def test_history_has_a_partition_a_ticker_and_reports_failures(spark, tmp_path):
    path = str(tmp_path / "a folder")
    bars(spark, ("A", "AA", "B C", "X/Y:Z")).write.partitionBy("ticker").parquet(path)
    got = feed.history(spark, path, ["A", "AA", "B C", "X/Y:Z", "GONE"])
    assert got.rdd.getNumPartitions() == 5
    assert {(r.ticker, r.bars, r.failed) for r in feed.report(got).collect()} == {("A", 30, False), ("AA", 30, False), ("B C", 30, False), ("X/Y:Z", 30, False), ("GONE", 0, True)}
    one = got.where("ticker = 'A'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 30
    two = feed.history(spark, path, ["A", "AA", "B C"]).where("ticker in ('AA', 'B C') and date >= date'2024-01-10' and date < date'2024-01-12'")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 4
    assert feed.history(spark, path, ["A"], "2024-01-05", "2024-01-06").count() == 2


class Flaky(feed.History):
    """Fails once for A, always for B."""

    @classmethod
    def name(cls):
        return "tidemark_flaky"

    def fetch(self, ticker, first, last):
        import os

        import pyarrow as pa

        mark = f"{self.options['path']}/{ticker}.tried"
        if ticker == "B" or not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        yield pa.RecordBatch.from_pydict({"Date": ["2024-01-02 00:00:00-05:00", "2024-01-03 00:00:00-05:00"], "Open": [None, 1.0], "High": [None, 2.0], "Low": [None, None], "Close": [None, 1.5], "Adj Close": [9.0, 9.0], "Volume": [7, None]})


def test_history_tries_again_and_normalises(spark, tmp_path):
    got = feed.history(spark, str(tmp_path), ["A", "B"], source=Flaky)
    rows = {r.ticker: r for r in market.written(got).collect()}
    assert rows["B"].error == "OSError: busy" and rows["B"].date is None
    assert tuple(rows["A"]) == (dt.date(2024, 1, 3), "A", 1.0, 2.0, None, 1.5, 0, None)


def test_universe_tells_tickers_by_their_folder(spark, tmp_path):
    schema = "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long"
    raw = spark.createDataFrame([("2024-01-02", 1.0, 1.0, 1.0, 1.0, 5.0, 5), ("2024-01-03", None, None, None, None, 6.0, 5), ("2024-01-04", None, None, None, 2.0, 6.0, None)], schema)
    root = tmp_path / "my data+x"
    for t, n in (("A", 1), ("AA", 3), ("B", 0)):
        raw.where(f"{n} > 0").repartition(max(1, n)).write.option("header", True).csv(str(root / t))
    rows, report = market.universe(spark, {t: str(root / t) for t in ("A", "AA", "B", "C")}, schema)
    assert rows.columns == ["date", "ticker", "open", "high", "low", "close", "volume"]
    assert sorted((r.ticker, r.date.day, r.volume) for r in rows.collect()) == [("A", 2, 5), ("A", 4, 0), ("AA", 2, 5), ("AA", 4, 0)]
    assert {tuple(r) for r in report.collect()} == {("A", False), ("AA", False), ("B", True), ("C", True)}


def ticks(spark, ids):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "S", 1.0 + i, 1.5 + i) for i in ids], "event_id long, time timestamp, symbol string, bid double, ask double")


def test_quote_feed_restarts_from_its_checkpoint(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    feed.publish(ticks(spark, range(50)).repartition(3), path, 1)
    feed.publish(ticks(spark, range(50, 60)), path, 2)
    stream = feed.quotes(spark, path, "me")
    assert feed.drained(stream, out, state).count() == 60
    assert feed.drained(feed.quotes(spark, path, "me"), out, state).count() == 60  # nothing new
    feed.publish(ticks(spark, range(60, 75)), path, 3)
    feed.publish(ticks(spark, range(75, 80)), path, 5)  # 4 isn't there yet
    got = feed.drained(feed.quotes(spark, path, "me"), out, state)
    assert sorted(r.event_id for r in got.collect()) == list(range(75))
    assert open(f"{path}/_consumers/me").read() == '{"segment": 2}'  # a batch is committed when the next one begins
    reader = feed.QuoteReader({"path": path}, ["event_id"])
    assert len(reader.partitions({"segment": 0}, {"segment": 1})) == 3 and reader.partitions({"segment": 3}, {"segment": 3}) == []
    assert reader.latestOffset() == {"segment": 3}


def scanned(df):
    """Files and partitions that the file scan of a plan that has run read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        if "FileSourceScan" in p.getClass().getSimpleName():
            m = p.metrics()
            found.append({k: m.apply(k).value() for k in ("numFiles", "numPartitions") if m.contains(k)})
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return found


def test_merge_opens_the_batchs_days_alone(spark, tmp_path):
    path = str(tmp_path / "quotes")
    day = ticks(spark, range(0, 14400, 10)).withColumn("day", F.to_date("time"))  # ten days
    assert store.merge(spark, path, day, ["time", "symbol"]) == 1440
    batch = ticks(spark, [1440, 1441, 1441, 1450]).withColumn("bid", F.lit(-1.0)).withColumn("day", F.to_date("time"))
    assert scanned(store.touched(spark, path, batch, ["time", "symbol"], "day"))[0]["numPartitions"] == 1
    assert store.merge(spark, path, batch, ["time", "symbol"]) == 1  # two are there, one comes twice
    assert store.merge(spark, path, batch, ["time", "symbol"]) == 0
    whole = spark.read.parquet(path)
    assert whole.count() == 1441 and whole.where("bid < 0").count() == 1
    untouched = {f: (tmp_path / "quotes" / f).stat().st_mtime_ns for f in ["day=2024-01-05"]}
    store.replace(spark, path, batch, ["time", "symbol"])
    whole = spark.read.parquet(path)
    assert whole.count() == 1441 and whole.where("bid < 0").count() == 3
    assert {f: (tmp_path / "quotes" / f).stat().st_mtime_ns for f in untouched} == untouched


def test_windowed_reads_the_range_and_its_lookback(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_sorted(bars(spark, days=300), path)
    made = lambda rows: P.adv(rows.withColumn("dollar_volume", F.col("close") * F.col("volume"))) if hasattr(P, "adv") else rows
    got = store.windowed(spark, path, "2024-06-01", "2024-06-10", 30, made, ["A"])
    want = made(spark.read.parquet(path).where("ticker = 'A'")).where("date between date'2024-06-01' and date'2024-06-10'")
    assert got.count() == 10 and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "GreaterThanOrEqual(date,2024-05-02)" in plan


def test_log_has_each_run_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    log = store.Log(spark, path, "at int, what string")
    assert log.read().count() == 0 and log.read().columns == ["at", "what", "run"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "at int, what string")
    assert log.append(rows, "r1") and not log.append(rows, "r1")
    rows.write.parquet(f"{path}/data/run=r2/attempt=killed")  # without its commit record
    assert log.read().count() == 2
    wide = spark.createDataFrame([(1 << 40, "c", {"k": "v"})], "at long, what string, details map<string,string>")
    assert log.append(wide, "r2")
    got = {(r.at, r.what, r.run): r.details for r in log.read().collect()}
    assert got == {(1, "a", "r1"): None, (2, "b", "r1"): None, (1 << 40, "c", "r2"): {"k": "v"}}
    assert {(r.run, r.rows) for r in log.commits().collect()} == {("r1", 2), ("r2", 1)}
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([("x",)], "at string"), "r3")
    with pytest.raises(ValueError):
        log.append(rows, "../r4")
    assert not log._commit(f"{path}/commits/r1.json", {"run": "r1", "attempt": "late", "rows": 0, "schema": rows.schema.json()})
    assert log.read().where("run = 'r1'").count() == 2


def test_gate_fails_the_write_and_leaves_no_table(spark, tmp_path):
    rows, path = bars(spark), str(tmp_path / "gated")
    hard, soft = {"high_below_low": F.col("high") < F.col("low"), "negative": F.col("close") < 0}, {"thin": F.col("volume") < 1005, "unknown": F.col("open").isNull()}
    bad = rows.withColumn("close", F.when((F.col("ticker") == "AA") & (F.dayofmonth("date") == 7), -1.0).otherwise(F.col("close")))
    with pytest.raises(Exception, match="bad row: negative .*2024-01-07"):
        store.gated(bad, path, hard, soft)
    assert not (tmp_path / "gated").exists()
    assert store.gated(rows, path, hard, soft) == {"rows": 90, "thin": 15, "unknown": 0}
    assert spark.read.parquet(path).count() == 90
    with pytest.raises(FileExistsError):
        store.gated(rows, path, hard)


def test_cache_knows_its_inputs(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []
    bars(spark).write.parquet(source)
    make = lambda: calls.append(1) or spark.read.parquet(source).groupBy("ticker").count()
    for _ in range(2):
        assert store.cached(spark, root, [source], {"days": 60}, make).count() == 3
    assert len(calls) == 1
    assert store.cached(spark, root, [source], {"days": 61}, make).count() == 3 and len(calls) == 2
    bars(spark, ("D",)).write.mode("append").parquet(source)
    assert store.cached(spark, root, [source], {"days": 60}, make).count() == 4 and len(calls) == 3


@pytest.mark.parametrize("cut", [1, 4])
def test_breaker_stream_is_the_same_however_it_is_cut(spark, tmp_path, cut):
    draw, rows, start = random.Random(6), [], dt.datetime(2024, 1, 1)
    for p in "AB":
        value = 1000.0
        for i in range(120):
            value *= 1 + draw.uniform(-0.03, 0.03)
            kind = "reset" if i % 37 == 36 else "order" if i % 5 == 4 else "nav"
            rows.append((p, start + dt.timedelta(seconds=i // 2 * 2), i, kind, None if kind != "nav" or i % 29 == 28 else value))
    want = {}
    for p in "AB":
        peak, halted, nav = 0.0, False, 0.0
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], breaker.KINDS.index(r[3]), r[2])):
            if r[3] == "nav" and r[4] is not None:
                nav, peak = r[4], max(peak, r[4])
                halted = halted or (nav - peak) / peak < -0.05
            halted = halted and r[3] != "reset"
            want[p, r[2]] = ((nav - peak) / peak, halted, not halted if r[3] == "order" else None)
    assert len({v[2] for v in want.values()}) == 3
    source = str(tmp_path / "in")
    for k in range(cut):  # each file holds rows of all times within a minute
        part = [r for i, r in enumerate(rows) if i % cut == k] + [("~", start + dt.timedelta(days=1), 0, "nav", 1.0)] * (k == cut - 1)
        draw.shuffle(part)
        spark.createDataFrame(part, breaker.INPUT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(breaker.INPUT).option("maxFilesPerTrigger", 1).parquet(source)
    got = feed.drained(breaker.answered(stream, "5 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).where("portfolio != '~'")
    assert {(r.portfolio, r.seq): (pytest.approx(r.drawdown), r.halted, r.allowed) for r in got.collect()} == want


class _State:
    """A value or a map of a stateful processor, in memory."""

    def __init__(self):
        self.value, self.map = None, {}
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.update, self.keys = lambda v: setattr(self, "value", v), lambda: iter(list(self.map))
        self.updateValue, self.getValue, self.removeKey = self.map.__setitem__, self.map.__getitem__, self.map.__delitem__


def test_breaker_holds_a_bounded_part_of_what_waits():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    n, draw = 200_000, np.random.default_rng(3)
    nav = 1000 * np.exp(np.cumsum(draw.normal(0, 0.01, n)))
    kind = np.where(np.arange(n) % 97 == 0, "reset", np.where(np.arange(n) % 7 == 0, "order", "nav"))
    rows = pd.DataFrame({"portfolio": "A", "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, unit="s"), "seq": np.arange(n), "kind": kind, "nav": np.where(kind == "nav", nav, np.nan)})
    mixed = rows.sample(frac=1, random_state=1)
    states, timers = {}, []
    made = lambda name, *_: states.setdefault(name, _State())
    unit = breaker.Breaker(0.05, 10_000, 1000)
    unit.init(SimpleNamespace(getMapState=made, getValueState=made, getListState=made, registerTimer=timers.append))
    assert list(unit.handleInputRows(("A",), (mixed[i : i + 5000] for i in range(0, n, 5000)), None)) == []
    got, most, last = [], 0, int(rows.time.max().timestamp() * 1000)
    for passed in (last // 2 + int(rows.time.min().timestamp() * 1000) // 2, last + 1):
        tracemalloc.start()
        kept = 0  # the parts that this test keeps
        for part in unit.handleExpiredTimer(("A",), SimpleNamespace(getCurrentWatermarkInMs=lambda p=passed: p), None):
            assert len(part) <= 1000 and int(part.time.max().timestamp() * 1000) <= passed
            most = max(most, tracemalloc.get_traced_memory()[1] - kept)
            got.append(part.copy())
            kept = tracemalloc.get_traced_memory()[0]
            tracemalloc.reset_peak()
        tracemalloc.stop()
    got = pd.concat(got)
    assert not states["waiting"].map and timers
    peak, halted, value, want = 0.0, False, 0.0, []
    for r in rows.assign(place=rows.kind.map(breaker.KINDS.index)).sort_values(["time", "place", "seq"]).itertuples():
        if r.kind == "nav":
            value, peak = r.nav, max(peak, r.nav)
            halted = halted or (value - peak) / peak < -0.05
        halted = halted and r.kind != "reset"
        want.append((r.seq, (value - peak) / peak if peak else None, halted, not halted if r.kind == "order" else None))
    down = [None if x != x else x for x in got.drawdown.tolist()]
    assert list(zip(got.seq.tolist(), down, got.halted.tolist(), got.allowed.tolist(), strict=True)) == want
    assert most < 5 << 20  # 100,000 rows as Python tuples take some 20 MB


def test_ledger_loads_base64_csv_once(spark, tmp_path):
    import base64

    from tidemark.operators import books

    text = "symbol,side,quantity,price,expected_price,market_impact_bps,commission,date,note\r\nA,BUY,10,11.0,10.0,5.0,0.05,2024-01-02,x\r\nB,SELL,5,9.0,10.0,,0.1,2024-01-03,y\n"
    book = books.Ledger(spark, str(tmp_path / "ledger"))
    encoded = base64.b64encode(text.encode()).decode()
    assert book.pnl().first().num_trades == 0
    assert book.load(encoded) and not book.load(encoded)
    assert sorted(tuple(r)[:4] for r in book.fills().collect()) == [("A", "BUY", 10, 11.0), ("B", "SELL", 5, 9.0)]
    got = book.pnl().first()
    assert (got.num_trades, got.gross_pnl, got.total_volume) == (2, 15.0, 15) and got.total_commission == pytest.approx(0.15)
    assert book.load("", "empty") and book.fills().count() == 2


def test_walk_forward_text(spark):
    from tidemark.operators import backtest, books

    rows = spark.createDataFrame([(i // 50, DAY + dt.timedelta(i), 0.01 * (-1) ** i + 0.001) for i in range(100)], "split int, date date, ret double")
    lines = [r.line for r in books.walk_forward_text(rows, backtest.sharpe(F.col("ret"))).orderBy("n").collect()]
    assert lines[:2] == ["days 100, splits 2", "annual return 25.20%"] and len(lines) == 5
    assert lines[3].startswith("split 1: 2024-01-01 to 2024-02-19, Sharpe ")


def test_ledger_log_joins_its_fills_once(spark, monkeypatch):
    from tests import compare
    from tidemark import catalog
    from tidemark.operators import books

    plans, record = [], books.Ledger.record
    monkeypatch.setattr(books.Ledger, "record", lambda self, fills, run: plans.append(fills._jdf.queryExecution().optimizedPlan().toString()) or record(self, fills, run))
    assert not compare.difference(spark, catalog.queries()["ledger_log"], catalog.oracle_sql()["ledger_log"], "/root/testdata/sf0.001")
    assert len(plans) == 13 and not any("Join" in p for p in plans)  # a run that joins would broadcast the dimensions again

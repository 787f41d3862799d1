"""Registered queries of the market-analytics engine and their DuckDB SQL.

Doubles are rounded alike on both sides, since sums run in different orders: a thousandth of the last place is added first,
so that exact halves don't hang on the last bit, and 0.0 after, so that no -0.0 is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from . import oracle as O
from .functions import rolling as R
from .operators import backtest as B
from .operators import books
from .operators import execution as X
from .operators import indicators as I
from .operators import models as L
from .operators import prices as P
from .operators import risk as K
from .operators import signals as S
from .operators.audit import look_ahead
from .sources import feed, store
from .sources import market as M
from .streaming import breaker
from .streaming import quotes as Q

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def add(name: str, made: Callable[[SparkSession, str], DataFrame], sql: str = "", doubles: str = "", digits: int = 6) -> None:
    columns, tie = doubles.split(), float(f"1e-{digits + 3}")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = made(spark, sf_dir)
        return df.withColumns({c: F.round(F.col(c) + tie, digits) + 0.0 for c in columns}) if columns else df

    _QUERIES[name] = query
    if sql:
        with_ = f"WITH RECURSIVE {sql}" if not sql.lstrip().startswith("SELECT") else sql
        replaced = ", ".join(f"round(CAST({c} AS DOUBLE) + {tie!r}, {digits}) + 0.0 AS {c}" for c in columns)
        _SQL[name] = f"SELECT *{f' REPLACE ({replaced})' if columns else ''} FROM ({with_})"


def ret():
    return F.col("return").alias("ret")


bars, ledger = M.bars, M.ledger


def clean(s: SparkSession, d: str) -> DataFrame:
    """Clean bars, written once: most queries use them in several places."""
    return M.written(P.clean(M.bars(s, d)))


def traded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The composite signal and the clean bars that it is of."""
    c = clean(s, d)
    return M.written(S.composite(I.matrix(c))), c


def signal(s: SparkSession, d: str) -> DataFrame:
    return traded(s, d)[0]


def daily(s: SparkSession, d: str) -> DataFrame:
    return M.written(B.daily(*traded(s, d)))


def quotes(s: SparkSession, d: str) -> DataFrame:
    return Q.valid(M.raw_quotes(s, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-ticker indicators of cleaned bars with the ticker's summary (per ticker only: the smallest tables align on few dates)."""
    rows = clean(spark, sf_dir)
    own = rows.select("date", "ticker", "close", ret(), R.mean("close", 20).alias("sma_20"), R.deviation("return", 20).alias("volatility_20"))
    return own.join(P.universe_summary(rows).select("ticker", "days", "ann_return", "ann_vol", "max_drawdown"), "ticker")


# sources, reads, cleaning and quality
add("symbols", lambda s, d: bars(s, d).select(F.col("ticker").alias("symbol")).distinct().orderBy("symbol"), f"{O.BARS} SELECT DISTINCT ticker AS symbol FROM bars ORDER BY 1")
add("ohlcv_last_n", lambda s, d: bars(s, d).where(F.col("ticker") == F.upper(F.lit("asia"))).orderBy(F.desc("date")).limit(30), f"{O.BARS} SELECT * FROM bars WHERE ticker = upper('asia') ORDER BY date DESC LIMIT 30", "open high low close")
add("quotes_latest", lambda s, d: quotes(s, d).where("symbol = 'view'").orderBy(F.desc("time"), F.desc("event_id")).limit(100).select("event_id", "symbol", F.unix_micros("time").alias("time_us"), "bid", "ask", "mid", "spread_bps"), f"{O.QUOTES} SELECT event_id, symbol, epoch_us(time) AS time_us, bid, ask, mid, spread_bps FROM valid WHERE symbol = 'view' ORDER BY time DESC, event_id DESC LIMIT 100", "bid ask mid spread_bps")
add("quote_filter", lambda s, d: quotes(s, d).select("event_id", "symbol", "bid", "ask", "mid", "spread_bps"), f"{O.QUOTES} SELECT event_id, symbol, bid, ask, mid, spread_bps FROM valid", "bid ask mid spread_bps")
add("symbol_summary", lambda s, d: P.symbol_summary(clean(s, d)), f"{O.CLEAN} SELECT symbol, trading_days, date_start, date_end, ann_volatility, last_close, round(pow(1 + tr, 252 / trading_days) - 1, 4) AS ann_return FROM (SELECT ticker AS symbol, count(*) AS trading_days, CAST(min(date) AS VARCHAR) AS date_start, CAST(max(date) AS VARCHAR) AS date_end, exp(sum(ln(1 + ret))) - 1 AS tr, round(coalesce(stddev_samp(ret) * sqrt(252), 0), 4) AS ann_volatility, round(max_by(close, date), 2) AS last_close FROM clean WHERE ticker <> 'TEST' GROUP BY 1)", "ann_volatility last_close ann_return", 4)


def status_counts(s: SparkSession, d: str) -> DataFrame:
    last = F.max("time").alias("last")
    q = quotes(s, d)
    recent = q.join(F.broadcast(q.agg(last))).agg(F.count_if(~F.col("symbol").isin("view", "click") | (F.col("time") > F.expr("last - interval 1 hour"))).alias("quote_ticks"), F.max_by("symbol", F.struct("time", "event_id")).alias("last_tick_symbol"), F.max(F.unix_micros("time")).alias("last_tick_us"))
    return bars(s, d).agg(F.count_if(F.col("ticker") != "TEST").alias("ohlcv_rows")).join(recent)


add("status_counts", status_counts, f"{O.BARS}, {O.QUOTES} SELECT (SELECT count(*) FROM bars WHERE ticker <> 'TEST') AS ohlcv_rows, count(*) FILTER (symbol NOT IN ('view', 'click') OR time > (SELECT max(time) FROM valid) - INTERVAL 1 HOUR) AS quote_ticks, max_by(symbol, row(time, event_id)) AS last_tick_symbol, max(epoch_us(time)) AS last_tick_us FROM valid")
add("clean_bars", lambda s, d: P.clean(M.bars(s, d)).select("date", "ticker", "open", "high", "low", "close", "volume", ret(), "log_return", "dollar_volume"), f"{O.CLEAN} SELECT date, ticker, open, high, low, close, volume, ret, log_return, dollar_volume FROM clean", "open high low close ret log_return dollar_volume")
add("validate_ohlcv", lambda s, d: P.validate(bars(s, d)), f"""{O.BARS}, c AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) AS change FROM bars),
 g AS (SELECT ticker, count(*) FILTER (high < low) AS a, count(*) FILTER (close > high * 1.001) AS b, count(*) FILTER (close < low * 0.999) AS c, count(*) FILTER (least(open, high, low, close) < 0) AS d, count(*) FILTER (change > 0.25) AS e, count(*) FILTER (volume = 0) AS f, count(*) FILTER (volume < 100000) AS g, count(*) AS have,
 (SELECT count(*) FROM (SELECT unnest(generate_series(min(c.date)::TIMESTAMP, max(c.date)::TIMESTAMP, INTERVAL 1 DAY)) AS x) WHERE dayofweek(x) BETWEEN 1 AND 5) AS expected FROM c GROUP BY 1),
 m AS (SELECT *, expected - have AS miss, (expected - have) / expected AS ratio FROM g)
 SELECT ticker, u.check, u.severity, u.n FROM m, LATERAL (VALUES ('high_below_low', 'issue', a), ('close_above_high', 'issue', b), ('close_below_low', 'issue', c), ('negative_price', 'issue', d), ('too_many_missing', 'issue', CASE WHEN ratio > 0.05 THEN miss ELSE 0 END), ('return_spike', 'warning', e), ('missing_days', 'warning', CASE WHEN ratio <= 0.05 THEN miss ELSE 0 END), ('zero_volume', 'warning', f), ('low_volume', 'warning', g)) AS u("check", severity, n) WHERE u.n > 0""")
_MISSING = "mb AS (SELECT ticker, (SELECT count(*) FROM days) AS expected_days, count(*) AS actual_days FROM bars WHERE close IS NOT NULL GROUP BY 1)"
add("missing_bars", lambda s, d: P.missing_bars(bars(s, d)), f"{O.BARS}, {O.CALENDAR}, {_MISSING} SELECT *, expected_days - actual_days AS missing_days, (expected_days - actual_days) / expected_days AS missing_ratio, (expected_days - actual_days) / expected_days <= 0.05 AS passed FROM mb", "missing_ratio")
add("return_spikes", lambda s, d: P.return_spikes(clean(s, d), 0.06), f"{O.CLEAN} SELECT ticker, count(*) FILTER (abs(ret) > 0.06) AS spike_count, coalesce(max(ret) FILTER (abs(ret) > 0.06), 0) AS max_return, coalesce(min(ret) FILTER (abs(ret) > 0.06), 0) AS min_return, coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (abs(ret) > 0.06), '') AS spike_dates FROM clean GROUP BY 1", "max_return min_return")
add("zero_volume", lambda s, d: P.zero_volume(bars(s, d).withColumn("volume", F.when(F.col("volume") > 40_000, F.col("volume")).otherwise(0))), f"{O.BARS}, b AS (SELECT date, ticker, CASE WHEN volume > 40000 THEN volume ELSE 0 END AS volume FROM bars) SELECT ticker, count(*) FILTER (volume = 0) AS zero_days, count(*) FILTER (volume = 0) / count(volume) AS zero_ratio, coalesce(array_to_string((list(CAST(date AS VARCHAR) ORDER BY date) FILTER (volume = 0))[1:3], ','), '') AS first_dates FROM b GROUP BY 1", "zero_ratio")
add("ohlc_sanity", lambda s, d: P.ohlc_sanity(bars(s, d)), f"{O.BARS} SELECT ticker, a AS high_below_low, b AS close_outside, a + b AS errors, a + b = 0 AS passed FROM (SELECT ticker, count(*) FILTER (high < low) AS a, count(*) FILTER (close < low) + count(*) FILTER (close > high) AS b FROM bars GROUP BY 1)")
_GAPS = "ab AS (SELECT d.date, t.ticker FROM days d, (SELECT DISTINCT ticker FROM bars) t WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.date = d.date AND b.ticker = t.ticker)), isl AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS island FROM ab), gaps AS (SELECT ticker, min(date) AS gap_start, max(date) AS gap_end, count(*) AS days FROM isl GROUP BY ticker, island HAVING count(*) > {0})"
add("price_gaps", lambda s, d: P.price_gaps(bars(s, d), 1), f"{O.BARS}, {O.CALENDAR}, {_GAPS.format(1)} SELECT * FROM gaps")
add("quality_report", lambda s, d: P.quality_report(M.written(bars(s, d))), f"""{O.CLEAN}, {O.CALENDAR}, {_MISSING}, {_GAPS.format(3)}, g AS (SELECT ticker, count(*) AS large_gaps, max(days) AS max_gap_days FROM gaps GROUP BY 1),
 sp AS (SELECT ticker, count(*) FILTER (abs(ret) > 0.25) AS spike_count, coalesce(max(ret) FILTER (abs(ret) > 0.25), 0) AS max_return, coalesce(min(ret) FILTER (abs(ret) > 0.25), 0) AS min_return FROM clean GROUP BY 1),
 z AS (SELECT ticker, count(*) FILTER (volume = 0) AS zero_days, count(*) FILTER (volume = 0) / count(volume) AS zero_ratio, count(*) FILTER (high < low) + count(*) FILTER (close < low) + count(*) FILTER (close > high) AS ohlc_errors FROM bars GROUP BY 1),
 j AS (SELECT mb.ticker, (expected_days - actual_days) / expected_days AS missing_ratio, expected_days - actual_days AS missing_days, (expected_days - actual_days) / expected_days <= 0.05 AS missing_ratio_pass, coalesce(spike_count, 0) AS spike_count, coalesce(max_return, 0) AS max_return, coalesce(min_return, 0) AS min_return, zero_days, zero_ratio, ohlc_errors, ohlc_errors = 0 AS ohlc_passed, coalesce(large_gaps, 0) AS large_gaps, coalesce(max_gap_days, 0) AS max_gap_days, coalesce(large_gaps, 0) > 0 AS has_large_gap FROM mb JOIN z USING (ticker) LEFT JOIN sp USING (ticker) LEFT JOIN g USING (ticker))
 SELECT *, 100 - (missing_ratio * 100 * 0.3 + spike_count / 10 * 0.2 + zero_days * 0.5 + ohlc_errors * 5 + large_gaps * 2) AS quality_score FROM j""", "missing_ratio max_return min_return zero_ratio quality_score")


def upsert_bars(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    return M.upsert(b.where("ticker < 'B'").select("date", "ticker", "close"), b.select("date", "ticker", "close").unionByName(b.select("date", "ticker", (F.col("close") + 1).alias("close"))), ["date", "ticker"])


add("upsert_bars", upsert_bars, f"{O.BARS} SELECT date, ticker, min(close) AS close FROM (SELECT date, ticker, close FROM bars UNION ALL SELECT date, ticker, close + 1 FROM bars) n WHERE NOT EXISTS (SELECT 1 FROM bars e WHERE e.ticker < 'B' AND e.date = n.date AND e.ticker = n.ticker) GROUP BY 1, 2", "close")
add("business_days", lambda s, d: M.business_days(bars(s, d).agg(F.min("date").alias("first"), F.max("date").alias("last"))), f"{O.BARS}, {O.CALENDAR} SELECT date FROM days")

# universe
_ALIGNED = "al AS (SELECT * FROM clean WHERE date IN (SELECT date FROM clean GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM clean)))"
TICKERS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
add("price_matrix_aligned", lambda s, d: P.aligned(clean(s, d)).select("date", "ticker", "close", "dollar_volume"), f"{O.CLEAN}, {_ALIGNED} SELECT date, ticker, close, dollar_volume FROM al", "close dollar_volume")
add("price_matrix_wide", lambda s, d: P.wide(P.aligned(clean(s, d)), "close", TICKERS).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST"), f"{O.CLEAN}, {_ALIGNED} SELECT date, " + ", ".join(f"max(close) FILTER (ticker = '{t}') AS {t.replace(' ', '_')}" for t in TICKERS) + " FROM al GROUP BY 1", " ".join(t.replace(" ", "_") for t in TICKERS))


def returns_matrix(s: SparkSession, d: str) -> DataFrame:
    rows = P.aligned(clean(s, d))
    return rows.select("date", "ticker", (F.try_divide("close", R.lag("close")) - 1).alias("ret"), F.ln(F.try_divide("close", R.lag("close"))).alias("log_return")).where("ret is not null")


_RETURNS = f"{O.CLEAN}, {_ALIGNED} SELECT * FROM (SELECT date, ticker, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS log_return FROM al WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE ret IS NOT NULL"
add("returns_matrix", lambda s, d: returns_matrix(s, d).drop("log_return"), f"SELECT date, ticker, ret FROM (WITH {_RETURNS})", "ret")
add("log_returns", lambda s, d: returns_matrix(s, d).drop("ret"), f"SELECT date, ticker, log_return FROM (WITH {_RETURNS})", "log_return")
add("adv_20", lambda s, d: P.adv(clean(s, d)), f"{O.CLEAN} SELECT date, ticker, {O.mean('dollar_volume', 20)} AS adv FROM clean", "adv", 2)
add("universe_summary", lambda s, d: P.universe_summary(clean(s, d)), f"""{O.CLEAN}, e AS (SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS eq FROM clean), f AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM e)
 SELECT ticker, min(date) AS start, max(date) AS "end", count(*) AS days, round(pow(1 + avg(ret), 252) - 1, 4) AS ann_return, round(stddev_samp(ret) * sqrt(252), 4) AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 3) AS sharpe, round(min(dd), 4) AS max_drawdown, round(avg(dollar_volume) / 1e6, 2) AS adv_millions FROM f GROUP BY 1""", "ann_return ann_vol sharpe max_drawdown adv_millions", 4)
_CORR = "pr AS (SELECT a.ticker AS t1, b.ticker AS t2, count(*) AS n, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr FROM clean a JOIN clean b USING (date) WHERE a.ticker <= b.ticker GROUP BY 1, 2)"
add("corr_matrix", lambda s, d: P.pairs(clean(s, d)), f"{O.CLEAN}, {_CORR} SELECT t1, t2, n, cov, corr FROM pr", "cov corr", 9)
add("avg_pairwise_corr", lambda s, d: P.average_pairwise(clean(s, d)), f"{O.CLEAN}, {_CORR} SELECT avg(m) AS avg_corr FROM (SELECT t2, avg(corr) AS m FROM pr WHERE t1 < t2 GROUP BY 1)", "avg_corr")
add("bench_corr", lambda s, d: P.benchmark_corr(clean(s, d)), f"{O.CLEAN}, b AS (SELECT date, avg(ret) AS bench FROM clean GROUP BY 1) SELECT ticker, corr(ret, bench) AS corr FROM clean JOIN b USING (date) GROUP BY 1", "corr")

# indicators
_of = lambda f, *c: lambda s, d: f(clean(s, d)).select("date", "ticker", *c)
add("sma", _of(lambda x: x.withColumns({"sma_20": R.mean("close", 20), "sma_50": R.mean("close", 50)}), "sma_20", "sma_50"), f"{O.CLEAN} SELECT date, ticker, {O.mean('close', 20)} AS sma_20, {O.mean('close', 50)} AS sma_50 FROM clean", "sma_20 sma_50")
add("ema", _of(lambda x: I.ema(x, "close", 20, "ema_20"), "ema_20"), f"{O.CLEAN}, {O.EMA20} SELECT date, ticker, CASE WHEN rn >= 20 THEN v END AS ema_20 FROM clean JOIN e20 USING (ticker, rn)", "ema_20")
add("rsi", _of(I.rsi, "rsi_14"), f"{O.CLEAN}, {O.RSI} SELECT date, ticker, rsi_14 FROM clean LEFT JOIN rsi USING (ticker, date)", "rsi_14")
add("macd", _of(I.macd, "macd_line", "macd_signal", "macd_hist"), f"{O.CLEAN}, {O.MACD} SELECT date, ticker, macd_line, macd_signal, macd_hist FROM clean LEFT JOIN macd USING (ticker, date)", "macd_line macd_signal macd_hist", 4)
add("bollinger", _of(I.bollinger, "bb_upper_20", "bb_mid_20", "bb_lower_20"), f"{O.CLEAN}, m AS (SELECT date, ticker, {O.mean('close', 20)} AS a, {O.deviation('close', 20)} AS s FROM clean) SELECT date, ticker, a + 2 * s AS bb_upper_20, a AS bb_mid_20, a - 2 * s AS bb_lower_20 FROM m", "bb_upper_20 bb_mid_20 bb_lower_20")
add("atr", _of(I.atr, "atr_14"), f"{O.CLEAN}, {O.ATR} SELECT date, ticker, atr_14 FROM clean LEFT JOIN atr USING (ticker, date)", "atr_14")
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"
add("alpha_001", _of(I.alpha_001, "alpha_001"), f"{O.CLEAN} SELECT date, ticker, sign(ret - lag(ret) OVER w) * -(close - lag(close) OVER w) AS alpha_001 FROM clean {_W}", "alpha_001")
add("alpha_002", _of(I.alpha_002, "alpha_002"), f"{O.CLEAN}, {O.ALPHA2} SELECT date, ticker, alpha_002 FROM a2", "alpha_002")
add("alpha_012", _of(I.alpha_012, "alpha_012"), f"{O.CLEAN} SELECT date, ticker, sign(volume - lag(volume) OVER w) * -(close - lag(close) OVER w) AS alpha_012 FROM clean {_W}", "alpha_012")
add("price_to_sma", _of(lambda x: x.withColumn("price_to_sma_20", F.col("close") / R.mean("close", 20) - 1), "price_to_sma_20"), f"{O.CLEAN} SELECT date, ticker, close / ({O.mean('close', 20)}) - 1 AS price_to_sma_20 FROM clean", "price_to_sma_20")
add("volatility_20", _of(lambda x: x.withColumn("volatility_20", R.deviation("return", 20)), "volatility_20"), f"{O.CLEAN} SELECT date, ticker, {O.deviation('ret', 20)} AS volatility_20 FROM clean", "volatility_20")
add("volume_ratio", _of(lambda x: x.withColumn("volume_ratio_20", F.col("volume") / R.mean("volume", 20)), "volume_ratio_20"), f"{O.CLEAN} SELECT date, ticker, volume / ({O.mean('volume', 20)}) AS volume_ratio_20 FROM clean", "volume_ratio_20")
add("zscore_60", _of(lambda x: x.withColumn("zscore", R.zscore("return", 60)), "zscore"), f"{O.CLEAN} SELECT date, ticker, {O.zscore('ret', 60)} AS zscore FROM clean", "zscore")
add("skew_60", _of(lambda x: x.withColumn("skew", R.skewness("return", 60)), "skew"), f"{O.CLEAN} SELECT date, ticker, CASE WHEN count(ret) OVER {O.rolled(60)} >= 60 THEN skewness(ret) OVER {O.rolled(60)} END AS skew FROM clean", "skew")
add("kurt_60", _of(lambda x: x.withColumn("kurt", R.kurtosis("return", 60)), "kurt"), f"{O.CLEAN} SELECT date, ticker, CASE WHEN count(ret) OVER {O.rolled(60)} >= 60 THEN kurtosis(ret) OVER {O.rolled(60)} END AS kurt FROM clean", "kurt")
add("amihud_21", _of(lambda x: I.amihud(x, 21, "amihud"), "amihud"), f"{O.CLEAN}, a AS (SELECT *, CASE WHEN dollar_volume <> 0 THEN abs(ret) / (dollar_volume + 1e-9) END AS am FROM clean) SELECT date, ticker, {O.mean('am', 21)} AS amihud FROM a", "amihud", 18)
add("cs_rank_returns", _of(lambda x: I.cross_rank(x, "return", "cs_rank"), "cs_rank"), f"{O.CLEAN}, nn AS (SELECT count(DISTINCT ticker) AS n FROM clean), r AS (SELECT date, ticker, {O.average_rank('ret', 'date')} AS a FROM clean) SELECT date, ticker, 2 * (a - 1) / (n - 1) - 1 AS cs_rank FROM r, nn", "cs_rank")
add("cs_rank_vol", lambda s, d: I.cross_rank(I.union_volatility(clean(s, d)), "uvol", "cs_rank").select("date", "ticker", "cs_rank"), f"{O.CLEAN}, {O.UNION_VOLATILITY}, nn AS (SELECT count(DISTINCT ticker) AS n FROM clean), r AS (SELECT date, ticker, {O.average_rank('uvol', 'date')} AS a FROM uv) SELECT date, ticker, 2 * (a - 1) / (n - 1) - 1 AS cs_rank FROM r, nn", "cs_rank")
add("cs_rank_rsi", _of(lambda x: I.cross_rank(I.rsi(x), "rsi_14", "cs_rank"), "cs_rank"), f"{O.CLEAN}, {O.RSI}, nn AS (SELECT count(DISTINCT ticker) AS n FROM clean), r AS (SELECT c.date, c.ticker, {O.average_rank('rsi_14', 'c.date')} AS a FROM clean c LEFT JOIN rsi USING (ticker, date)) SELECT date, ticker, 2 * (a - 1) / (n - 1) - 1 AS cs_rank FROM r, nn", "cs_rank")
_FEATURES = " ".join(c for c in I.MATRIX if c != "amihud_illiquidity")
add("feature_matrix", lambda s, d: I.matrix(clean(s, d)).withColumn("amihud_illiquidity", F.round("amihud_illiquidity", 18)), f"{O.MATRIX} SELECT * REPLACE (round(amihud_illiquidity, 18) AS amihud_illiquidity) FROM matrix", _FEATURES, 4)

# labels, splits, signals
add("forward_returns", _of(S.forward_returns, "forward_return"), f"{O.CLEAN} SELECT date, ticker, lead(close, 5) OVER w / close - 1 AS forward_return FROM clean {_W}", "forward_return")
add("barrier_labels", _of(S.barrier_labels, "label"), f"{O.CLEAN}, f AS (SELECT date, ticker, lead(close, 5) OVER w / close - 1 AS f, {O.deviation('ret', 20)} AS v FROM clean {_W}) SELECT date, ticker, CAST(CASE WHEN f > v THEN 1 WHEN f < -v THEN -1 ELSE 0 END AS INTEGER) AS label FROM f")
_SP = "SELECT CAST(split AS INTEGER) AS split, CAST(train_start AS INTEGER) AS train_start, CAST(train_end AS INTEGER) AS train_end, CAST(test_start AS INTEGER) AS test_start, CAST(test_end AS INTEGER) AS test_end FROM sp"
add("wf_splits", lambda s, d: S.purged_splits(clean(s, d), 0), f"{O.CLEAN}, {O.SPLITS.format(rows='clean', train=252)} {_SP}")
add("purged_splits", lambda s, d: S.purged_splits(clean(s, d)), f"{O.CLEAN}, {O.SPLITS.format(rows='clean', train=247)} {_SP}")
add("momentum_signal", lambda s, d: I.cross_rank(clean(s, d), "return", "cs").select("date", "ticker", S.momentum(F.col("cs")).alias("signal")), f"{O.CLEAN}, nn AS (SELECT count(DISTINCT ticker) AS n FROM clean), r AS (SELECT date, ticker, {O.average_rank('ret', 'date')} AS a FROM clean) SELECT date, ticker, 2 * (a - 1) / (n - 1) - 1 AS signal FROM r, nn", "signal")
add("rsi_signal", lambda s, d: I.rsi(clean(s, d)).select("date", "ticker", S.rsi_signal(F.col("rsi_14")).alias("signal")), f"{O.CLEAN}, {O.RSI} SELECT date, ticker, CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END AS signal FROM clean LEFT JOIN rsi USING (ticker, date)", "signal")
add("ml_signal", lambda s, d: M.read(s, d, "events").select("event_id", S.ml_signal(F.col("event_id") % 11 / 10).alias("signal"), S.bucket(F.col("event_id") % 11 / 10).alias("bucket")), "SELECT event_id, ((event_id % 11) / 10 - 0.5) * 2 AS signal, CAST(CASE WHEN (event_id % 11) / 10 > 0.6::DOUBLE THEN 1 WHEN (event_id % 11) / 10 < 0.4::DOUBLE THEN -1 ELSE 0 END AS INTEGER) AS bucket FROM events", "signal")
add("composite_signal", signal, f"{O.SIGNAL} SELECT date, ticker, signal FROM sig", "signal")
_RANKED = f"{O.SIGNAL}, nt AS (SELECT count(DISTINCT ticker) AS n FROM sig), rs AS (SELECT date, ticker, 2 * ({O.average_rank('signal', 'date')} - 1) / (n - 1) - 1 AS ranked_signal FROM (SELECT date, ticker, round(signal, 9) AS signal FROM sig), nt)"
ranked = lambda s, d: S.rank_signals(signal(s, d).withColumn("signal", F.round("signal", 9)))
add("ranked_signal", ranked, f"{_RANKED} SELECT date, ticker, ranked_signal FROM rs", "ranked_signal")
add("long_short", lambda s, d: S.long_short(ranked(s, d)), f"{_RANKED} SELECT date, ticker, ranked_signal, 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ranked_signal DESC, ticker) AS k FROM rs) WHERE k <= 2 UNION ALL SELECT date, ticker, ranked_signal, -1 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ranked_signal, ticker DESC) AS k FROM rs) WHERE k <= 2", "ranked_signal")
def ic_decay(s: SparkSession, d: str) -> DataFrame:
    signals, c = traded(s, d)
    return S.ic_decay(signals.withColumn("signal", F.round("signal", 9)), c)


add("ic_decay", ic_decay, f"""{O.SIGNAL}, f AS (SELECT date, ticker, {", ".join(f"lead(close, {h}) OVER w / close - 1 AS f{h}" for h in S.HORIZONS)} FROM clean {_W}),
 l AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, round(signal, 9) AS signal, f{h} AS f FROM sig JOIN f USING (date, ticker) WHERE f{h} IS NOT NULL" for h in S.HORIZONS)}), r AS (SELECT horizon, {O.average_rank("signal", "horizon")} AS a, {O.average_rank("f", "horizon")} AS b FROM l) SELECT horizon, count(*) AS n, corr(a, b) AS ic FROM r GROUP BY 1""", "ic")

# backtest and metrics
strategy = lambda s, d: B.strategy(*traded(s, d))
add("positions_lag", lambda s, d: B.positions(signal(s, d)).select("date", "ticker", "position"), f"{O.STRATEGY} SELECT date, ticker, position FROM pos", "position")
add("txn_costs", lambda s, d: B.costs(strategy(s, d)).select("date", "ticker", "gross", "cost"), f"{O.STRATEGY} SELECT date, ticker, gross, gross - ({O.net('10.0')}) AS cost FROM (SELECT * REPLACE (coalesce(gross, 0) AS gross) FROM strat) WHERE false UNION ALL SELECT date, ticker, gross, coalesce(change * (10.0 / 1e4 * close + 0.005) / nullif(abs(position) * close, 0), 0) FROM strat", "gross cost")
add("backtest_daily", daily, f"{O.DAILY} SELECT date, ret FROM dr", "ret")
add("equity_curve", lambda s, d: B.equity(daily(s, d)), f"{O.EQUITY} SELECT * FROM eq", "ret equity peak drawdown", 5)
add("cost_sensitivity", lambda s, d: B.cost_sensitivity(*traded(s, d)), f"{O.STRATEGY}, b AS (SELECT bps, date, sum(coalesce(({O.net('bps')}) / n, 0)) AS ret FROM strat, nt, unnest([0.0::DOUBLE, 5, 10, 20]) AS u(bps) GROUP BY 1, 2) SELECT bps, (avg(ret) - 0.00015) / stddev_samp(ret) * sqrt(252) AS sharpe FROM b GROUP BY 1", "bps sharpe")
add("inverse_vol_weights", lambda s, d: B.weights_inverse_volatility(clean(s, d)), f"{O.CLEAN}, v AS (SELECT ticker, 1 / stddev_samp(ret) AS i FROM clean GROUP BY 1) SELECT ticker, i / sum(i) OVER () AS weight FROM v", "weight")
add("walk_forward_oos", lambda s, d: B.walk_forward(*traded(s, d)), f"{O.SIGNAL}, {O.SPLITS.format(rows='sig', train=247)}, nt AS (SELECT count(DISTINCT ticker) AS n FROM sig), t AS (SELECT split, s.date, s.ticker, lag(signal) OVER (PARTITION BY split, s.ticker ORDER BY s.date) AS position FROM sig s JOIN ord USING (date) JOIN sp ON i >= test_start AND i < test_end) SELECT CAST(split AS INTEGER) AS split, date, sum(coalesce(position * ret / n, 0)) AS ret FROM t JOIN clean USING (date, ticker), nt GROUP BY 1, 2", "ret")
_SHARPE = "CASE WHEN stddev_samp(ret) > 0 THEN (avg(ret) - 0.00015) / stddev_samp(ret) * sqrt(252) ELSE 0 END"
_SORTINO = "CASE WHEN count(*) FILTER (ret < 0.00015) < 2 THEN NULL ELSE (avg(ret) - 0.00015) / (stddev_samp(ret - 0.00015) FILTER (ret < 0.00015)) * sqrt(252) END"
_FACTOR = "sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0)"
add("sharpe", lambda s, d: daily(s, d).agg(B.sharpe(F.col("ret")).alias("sharpe")), f"{O.DAILY} SELECT {_SHARPE} AS sharpe FROM dr", "sharpe")
add("sortino", lambda s, d: daily(s, d).agg(B.sortino(F.col("ret")).alias("sortino")), f"{O.DAILY} SELECT {_SORTINO} AS sortino FROM dr", "sortino")
add("calmar", lambda s, d: B.equity(daily(s, d)).agg(B.calmar(F.col("ret"), F.min("drawdown")).alias("calmar")), f"{O.EQUITY} SELECT avg(ret) * 252 / abs(min(drawdown)) AS calmar FROM eq", "calmar")
add("max_drawdown", lambda s, d: B.equity(daily(s, d)).agg(F.min("drawdown").alias("max_drawdown")), f"{O.EQUITY} SELECT min(drawdown) AS max_drawdown FROM eq", "max_drawdown")
_DURATION = "u AS (SELECT date, CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END AS up FROM eq), v AS (SELECT *, sum(up) OVER (ORDER BY date) AS run FROM u), du AS (SELECT CAST(coalesce(max(n - 1), 0) AS BIGINT) AS duration FROM (SELECT run, count(*) AS n FROM v WHERE up = 0 AND run < (SELECT max(run) FROM v) GROUP BY 1))"
add("dd_duration", lambda s, d: B.drawdown_duration(daily(s, d)), f"{O.EQUITY}, {_DURATION} SELECT duration FROM du")
add("hit_rate", lambda s, d: daily(s, d).agg(B.hit_rate(F.col("ret")).alias("hit_rate")), f"{O.DAILY} SELECT count(*) FILTER (ret > 0) / count(*) AS hit_rate FROM dr", "hit_rate")
add("profit_factor", lambda s, d: daily(s, d).agg(B.profit_factor(F.col("ret")).alias("profit_factor")), f"{O.DAILY} SELECT {_FACTOR} AS profit_factor FROM dr", "profit_factor")
_ROLLING = "rw AS (SELECT date, count(*) OVER w AS c, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM dr WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), rsh AS (SELECT date, CASE WHEN s > 0 THEN (m - 0.00015) / s * sqrt(252) ELSE 0 END AS rolling_sharpe FROM rw WHERE c >= 60)"
add("rolling_sharpe", lambda s, d: B.rolling_sharpe(daily(s, d)), f"{O.DAILY}, {_ROLLING} SELECT * FROM rsh", "rolling_sharpe")
_MONTHLY = "mo AS (SELECT date_trunc('month', date)::DATE AS m, product(1 + ret) - 1 AS r FROM dr GROUP BY 1), ms AS (SELECT unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM mo), mr AS (SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, coalesce(r, 0) AS ret FROM ms LEFT JOIN mo USING (m))"
add("monthly_returns", lambda s, d: B.monthly(daily(s, d)), f"{O.DAILY}, {_MONTHLY} SELECT * FROM mr", "ret")
_MONTHS = [f"m{m:02d}" for m in range(1, 13)]
add("monthly_table", lambda s, d: B.monthly_table(daily(s, d)), f"{O.DAILY}, {_MONTHLY} SELECT year, " + ", ".join(f"coalesce(max(ret) FILTER (month = {i + 1}), 0) AS {m}" for i, m in enumerate(_MONTHS)) + " FROM mr GROUP BY 1", " ".join(_MONTHS))
add("all_metrics", lambda s, d: B.all_metrics(daily(s, d)), f"{O.EQUITY}, {_DURATION}, {_ROLLING} SELECT {_SHARPE} AS sharpe, {_SORTINO} AS sortino, avg(ret) * 252 / abs(min(drawdown)) AS calmar, min(drawdown) AS max_drawdown, count(*) FILTER (ret > 0) / count(*) AS hit_rate, {_FACTOR} AS profit_factor, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_volatility, max_by(equity, date) / 1000000 - 1 AS total_return, max(ret) AS best_day, min(ret) AS worst_day, count(*) AS num_days, (SELECT duration FROM du) AS duration, (SELECT max_by(rolling_sharpe, date) FROM rsh) AS rolling_sharpe_last_60 FROM eq", "sharpe sortino calmar max_drawdown hit_rate profit_factor annual_return annual_volatility total_return best_day worst_day rolling_sharpe_last_60")

# risk
cov = lambda s, d: M.written(P.covariance(clean(s, d)))
add("covariance", cov, f"{O.COVARIANCE} SELECT * FROM cov", "cov", 9)
def risked(s: SparkSession, d: str, each: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Covariance and holdings, both of the same bars and as small as the universe."""
    c = clean(s, d)
    return M.written(P.covariance(c)), M.written(K.holdings(c, each))


add("parametric_var", lambda s, d: K.parametric_var(*risked(s, d)), f"{O.COVARIANCE}, k AS (SELECT count(DISTINCT ticker) AS n, (SELECT count(*) FROM ok) AS m FROM clean), q AS (SELECT sqrt(sum(cov) / any_value(n * n)) / any_value(m / n) AS sigma FROM cov, k) SELECT sigma, {config.Z95!r} * sigma * 1e6 AS var, -sigma * {config.PDF95!r} / 0.05 * 1e6 AS cvar, {config.Z95!r} * sigma AS var_percent FROM q", "sigma var cvar var_percent")
add("hist_cvar", lambda s, d: K.historical_cvar(daily(s, d)), f"{O.DAILY}, q AS (SELECT quantile_cont(ret, 0.05) AS q, count(*) AS n FROM dr) SELECT CASE WHEN any_value(n) >= 10 THEN -avg(ret) FILTER (ret <= q) ELSE 0 END AS cvar FROM dr, q", "cvar")
orders = lambda s, d: ledger(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "symbol", "side", "quantity", F.col("expected_price").alias("price"))
held = lambda s, d: K.holdings(clean(s, d), 0.02)
add("var_gate", lambda s, d: K.var_gate(orders(s, d), *risked(s, d, 0.02)), f"""{O.COVARIANCE}, {O.LEDGER}, o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side, quantity, expected_price AS price, row_number() OVER () AS k FROM ledger),
 f AS (SELECT k, sum((0.02 + CASE WHEN t1 = symbol THEN d ELSE 0 END) * (0.02 + CASE WHEN t2 = symbol THEN d ELSE 0 END) * cov) AS q FROM (SELECT k, symbol, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * quantity * price / 1e6 AS d FROM o), cov GROUP BY 1),
 v AS (SELECT o.*, {config.Z95!r} * sqrt(greatest(q, 0)) / (0.02 * (SELECT count(*) FROM ok) + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * quantity * price / 1e6) AS v, symbol IN (FROM ok) AS known FROM o LEFT JOIN f USING (k)),
 r AS (SELECT *, CASE WHEN side = 'BUY' AND quantity * price > 5e5 THEN 'ORDER_VALUE' WHEN NOT known THEN 'NO_COVARIANCE' WHEN side <> 'BUY' AND 0.02 - quantity * price / 1e6 < 0 THEN 'SELL_EXCEEDS_HOLDING' WHEN abs(v) > 0.02 THEN 'VAR_LIMIT' ELSE 'OK' END AS reason FROM v)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side, quantity, price, CASE WHEN reason IN ('OK', 'VAR_LIMIT') THEN v END AS var_percent, reason, reason = 'OK' AS approved FROM r""", "price var_percent")
nav = lambda s, d: B.equity(daily(s, d)).select("date", F.col("equity").alias("nav"), (F.dayofmonth("date") == 1).alias("reset"))
add("breaker_latch", lambda s, d: K.breaker(nav(s, d)), f"{O.EQUITY}, n AS (SELECT date, equity AS nav, day(date) = 1 AS reset, peak, drawdown, drawdown < -0.05 AS tripped FROM eq), e AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (ORDER BY date) AS era FROM n) SELECT date, nav, reset, peak, drawdown, tripped, bool_or(tripped AND NOT reset) OVER (PARTITION BY era ORDER BY date) AS halted FROM e", "nav peak drawdown", 5)
add("position_limits", lambda s, d: K.position_limits(orders(s, d), held(s, d), M.sectors(s)), f"{O.CLEAN}, {O.LEDGER}, {O.SECTORS}, t AS (SELECT DISTINCT ticker FROM clean), sw AS (SELECT coalesce(sector, 'Other') AS sector, sum(0.02) AS w FROM t LEFT JOIN sectors USING (ticker) GROUP BY 1), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side, quantity, expected_price AS price, coalesce(s.sector, 'Other') AS sector, 0.02::DOUBLE + quantity * expected_price / 1e6 AS nw, quantity * expected_price / 1e6 AS d FROM ledger LEFT JOIN sectors s ON s.ticker = symbol) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side, quantity, price, r.sector, CASE WHEN nw > 0.05::DOUBLE THEN 'STOCK_LIMIT' WHEN r.sector <> 'Other' AND w + d > 0.25::DOUBLE THEN 'SECTOR_LIMIT' ELSE 'OK' END AS limit_reason FROM r LEFT JOIN sw ON sw.sector = r.sector", "price")
add("sector_exposure", lambda s, d: K.sector_exposure(K.holdings(clean(s, d)), M.sectors(s)), f"{O.CLEAN}, {O.SECTORS}, t AS (SELECT DISTINCT ticker FROM clean), w AS (SELECT ticker, 1.0::DOUBLE / count(*) OVER () AS weight FROM t) SELECT coalesce(sector, 'Other') AS sector, sum(weight) AS weight, count(*) AS tickers, count(*) FILTER (weight > 0.05) AS stock_breaches, coalesce(sector, 'Other') <> 'Other' AND sum(weight) > 0.25 AS breach FROM w LEFT JOIN sectors USING (ticker) GROUP BY 1", "weight")


def factors(s: SparkSession, d: str) -> DataFrame:
    own = lambda t: F.max(F.when(F.col("ticker") == t, F.col("return")))
    return P.aligned(clean(s, d)).groupBy("date").agg(F.avg("return").alias("mkt"), (own("AFRICA") - own("ASIA")).alias("smb"), (own("EUROPE") - own("AMERICA")).alias("hml"), own("MIDDLE EAST").alias("y"))


add("factor_ols", lambda s, d: K.factor_ols(factors(s, d)), f"""{O.CLEAN}, {_ALIGNED}, g AS (SELECT date, avg(ret) AS m, max(ret) FILTER (ticker = 'AFRICA') - max(ret) FILTER (ticker = 'ASIA') AS s, max(ret) FILTER (ticker = 'EUROPE') - max(ret) FILTER (ticker = 'AMERICA') AS h, max(ret) FILTER (ticker = 'MIDDLE EAST') AS y FROM al GROUP BY 1),
 a AS (SELECT g.*, m - avg(m) OVER () AS m0, s - avg(s) OVER () AS s0, h - avg(h) OVER () AS h0, y - avg(y) OVER () AS y0 FROM g), k1 AS (SELECT sum(s0 * m0) / sum(m0 * m0) AS a, sum(h0 * m0) / sum(m0 * m0) AS b, sum(y0 * m0) / sum(m0 * m0) AS ym FROM a),
 b1 AS (SELECT x.*, x.s0 - k1.a * x.m0 AS s1 FROM a x, k1), k2 AS (SELECT sum(h0 * s1) / sum(s1 * s1) AS c, sum(y0 * s1) / sum(s1 * s1) AS ys FROM b1), c1 AS (SELECT x.*, x.h0 - k1.b * x.m0 - k2.c * x.s1 AS h1 FROM b1 x, k1, k2),
 k3 AS (SELECT sum(y0 * h1) / sum(h1 * h1) AS yh, sum(m0 * m0) AS vm, sum(s1 * s1) AS vs, sum(h1 * h1) AS vh, sum(y0 * y0) AS vy, count(*) AS n, avg(m) AS am, avg(s) AS as_, avg(h) AS ah, avg(y) AS ay FROM c1),
 z AS (SELECT yh AS beta_hml, ys - c * yh AS beta_smb, ym - a * (ys - c * yh) - b * yh AS beta_mkt, (ym * ym * vm + ys * ys * vs + yh * yh * vh) / vy AS r_squared, * FROM k1, k2, k3)
 SELECT ay - beta_mkt * am - beta_smb * as_ - beta_hml * ah AS alpha, beta_mkt, beta_smb, beta_hml, r_squared, 1 - (1 - r_squared) * (n - 1) / (n - 4) AS adj_r_squared, sqrt(vy * (1 - r_squared) / (n - 4)) AS resid_std, n, 252 * (ay - beta_mkt * am - beta_smb * as_ - beta_hml * ah) AS alpha_annual FROM z WHERE n >= 30""", "alpha beta_mkt beta_smb beta_hml r_squared adj_r_squared resid_std alpha_annual")

# execution and portfolio
_PRICED = f"{O.CLEAN}, {O.LEDGER}, lq AS (SELECT date, ticker AS symbol, lag(a) OVER w AS adv, lag(s) OVER w AS sigma FROM (SELECT date, ticker, {O.mean('dollar_volume', 20)} AS a, {O.deviation('ret', 20)} AS s FROM clean) {_W}), mi AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side, quantity, expected_price, CASE WHEN coalesce(adv, 0) <= 0 THEN 0.001 * (quantity / 10000) WHEN side = 'BUY' THEN 1 ELSE -1 END * CASE WHEN coalesce(adv, 0) <= 0 THEN 1 ELSE CASE WHEN sigma > 0 THEN sigma ELSE 0.02 END * sqrt(quantity / adv) END AS impact FROM ledger LEFT JOIN lq USING (date, symbol))"
priced = lambda s, d: X.priced(ledger(s, d), clean(s, d))
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "symbol", "side", "quantity")
add("market_impact", lambda s, d: priced(s, d).select(*_KEYS, "impact"), f"{_PRICED} SELECT {', '.join(_KEYS)}, impact FROM mi", "impact", 9)
add("exec_price", lambda s, d: priced(s, d).select(*_KEYS, "execution_price"), f"{_PRICED} SELECT {', '.join(_KEYS)}, expected_price * (1 + impact) AS execution_price FROM mi", "execution_price")


def order_routing(s: SparkSession, d: str) -> DataFrame:
    c = clean(s, d)
    matrix = [(r.t1, r.t2, r.cov) for r in P.covariance(c).collect()]  # of the universe's few tickers
    # as in the reference's wiring, no NAV reaches the router's breaker, so it never halts here
    rows = X.with_liquidity(ledger(s, d), c).select("portfolio", "date", *_KEYS, F.col("expected_price").alias("price"), "adv", "sigma", F.lit(False).alias("halted"))
    return X.route(rows, matrix, dict(config.SECTORS))


add("order_routing", order_routing)
add("ledger_pnl", lambda s, d: X.pnl(ledger(s, d)), f"{O.LEDGER}, p AS (SELECT sum(CASE WHEN side = 'BUY' THEN price - expected_price ELSE expected_price - price END * quantity) AS gross_pnl, sum(market_impact_bps * quantity / 10000) AS total_impact_cost, sum(commission) AS total_commission, CAST(sum(quantity) AS BIGINT) AS total_volume, count(*) AS num_trades FROM ledger) SELECT gross_pnl, total_impact_cost, total_commission, gross_pnl - total_impact_cost - total_commission AS net_pnl, total_volume, num_trades FROM p", "gross_pnl total_impact_cost total_commission net_pnl", 3)
_POSITIONS = f"{O.CLEAN}, {O.LEDGER}, nt AS (SELECT symbol, CAST(sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * quantity) AS BIGINT) AS quantity, sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * quantity * price) AS cost FROM ledger GROUP BY 1 HAVING sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * quantity) <> 0), ls AS (SELECT ticker AS symbol, max_by(close, date) AS last FROM clean GROUP BY 1), ps AS (SELECT symbol, quantity, round(entry, 2) AS entry_price, round(now, 2) AS current_price, round(quantity * (now - entry), 2) AS unrealized_pnl, round(CASE WHEN sum(quantity * now) OVER () > 0 THEN quantity * now / sum(quantity * now) OVER () * 100 ELSE 0 END, 2) AS weight_percent FROM (SELECT symbol, quantity, cost / quantity AS entry, coalesce(last, cost / quantity) AS now FROM nt LEFT JOIN ls USING (symbol)))"
add("positions", lambda s, d: X.positions(ledger(s, d), clean(s, d)), f"{_POSITIONS} SELECT * FROM ps", "entry_price current_price unrealized_pnl weight_percent", 2)
add("portfolio_summary", lambda s, d: X.portfolio_summary(ledger(s, d), clean(s, d)), f"{_POSITIONS}, h AS (SELECT sum(quantity * current_price) AS v, sum(quantity * entry_price) AS c, count(*) AS positions_count FROM ps), g AS (SELECT sum(CASE WHEN side = 'BUY' THEN price - expected_price ELSE expected_price - price END * quantity) AS g FROM ledger) SELECT round(v, 2) AS nav, round(v - c, 2) AS unrealized_pnl, round(g, 2) AS realized_pnl, round(v - c + g, 2) AS total_pnl, positions_count FROM h, g", "nav unrealized_pnl realized_pnl total_pnl", 2)
_DAILY_PNL = f"{O.LEDGER}, dp AS (SELECT date, sum((price - expected_price) * quantity) AS pnl FROM ledger GROUP BY 1), de AS (SELECT date, pnl, 1000000 + sum(pnl) OVER (ORDER BY date) AS equity FROM dp)"
add("daily_pnl", lambda s, d: X.daily_pnl(ledger(s, d)), f"{_DAILY_PNL} SELECT * FROM de", "pnl equity", 4)
add("portfolio_risk", lambda s, d: X.portfolio_risk(cov(s, d), X.daily_pnl(ledger(s, d)), K.breaker(X.daily_pnl(ledger(s, d)).select("date", F.col("equity").alias("nav"), F.lit(False).alias("reset")))), f"{O.COVARIANCE}, {_DAILY_PNL}, pk AS (SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 < -0.05 AS t FROM de) SELECT (SELECT round(1.645 * sqrt(greatest(avg(cov), 0)) * 100, 2) FROM cov) AS var_95_1d, round((max_by(equity, date) / max(equity) - 1) * 100, 2) AS current_drawdown, max_by(t, date) AS circuit_breaker_triggered, 5.0::DOUBLE AS drawdown_limit FROM pk", "var_95_1d current_drawdown drawdown_limit", 2)
add("order_gate_summary", lambda s, d: K.var_gate(orders(s, d), *risked(s, d, 0.02)).groupBy("reason").agg(F.count("*").alias("n")), f"SELECT reason, count(*) AS n FROM ({_SQL['var_gate']}) GROUP BY 1")

_SPLIT_SHARPE = f", c AS (SELECT split, date, n, position * ret AS gross, coalesce(abs(position - lag(position) OVER (PARTITION BY split, ticker ORDER BY date)) * ({config.SPREAD_BPS!r} / 1e4 * close + {config.COMMISSION!r}) / nullif(abs(position) * close, 0), 0) AS cost FROM t JOIN clean USING (date, ticker), nt), wd AS (SELECT split, date, sum(coalesce((gross - cost) / n, 0)) AS r FROM c GROUP BY 1, 2), ws AS (SELECT split, CASE WHEN stddev_samp(r) > 0 THEN (avg(r) - {config.RISK_FREE_DAILY!r}) / stddev_samp(r) * sqrt(252) ELSE 0 END AS s FROM wd GROUP BY 1) SELECT count(*) AS splits, avg(s) AS avg_split_sharpe FROM ws"
add("walk_forward_sharpe", lambda s, d: B.split_sharpes(B.walk_forward(*traded(s, d), bps=config.SPREAD_BPS)), f"{O.SIGNAL}, {O.SPLITS.format(rows='sig', train=247)}, nt AS (SELECT count(DISTINCT ticker) AS n FROM sig), t AS (SELECT split, s.date, s.ticker, lag(signal) OVER (PARTITION BY split, s.ticker ORDER BY s.date) AS position FROM sig s JOIN ord USING (date) JOIN sp ON i >= test_start AND i < test_end) {_SPLIT_SHARPE}", "avg_split_sharpe")
add("quality_stats", lambda s, d: P.quality_stats(P.quality_report(M.written(bars(s, d)))), f"SELECT count(*) AS tickers, avg(quality_score) AS mean_score, min(quality_score) AS min_score, max(quality_score) AS max_score, count(*) FILTER (missing_ratio_pass AND ohlc_passed) AS passed FROM ({_SQL['quality_report']})", "mean_score min_score max_score", 4)
_TEXT = [("days", "printf('days %d', num_days)"), *((c, f"printf('{c} %.2f%%', {c} * 100)") for c in ("annual_return", "annual_volatility", "total_return", "max_drawdown", "hit_rate", "best_day", "worst_day")), *((c, f"printf('{c} %.3f', {c})") for c in ("sharpe", "sortino", "calmar", "profit_factor"))]
add("metrics_text", lambda s, d: B.text_lines(B.all_metrics(daily(s, d))), f"SELECT CAST(unnest(range({len(_TEXT)})) AS INTEGER) AS n, unnest([{', '.join(t for _, t in _TEXT)}]) AS line FROM ({_SQL['all_metrics']})")
add("quote_liveness", lambda s, d: Q.liveness(quotes(s, d), "2024-01-01 00:00:00").select("symbol", F.unix_micros("time").alias("time_us"), "active"), f"{O.QUOTES} SELECT symbol, epoch_us(time) AS time_us, epoch(TIMESTAMP '2024-01-01') - epoch(time) < 60 AS active FROM valid ORDER BY time DESC, event_id DESC LIMIT 1")
add("gate_rate", lambda s, d: K.approval(K.var_gate(orders(s, d), *risked(s, d, 0.02))), f"SELECT count(*) AS orders, count(*) FILTER (approved) AS approved, count(*) FILTER (approved) / count(*) AS approval_rate FROM ({_SQL['var_gate']})", "approval_rate")
add("breaker_events", lambda s, d: K.filtered(K.risk_events(K.breaker(nav(s, d))), "CIRCUIT_BREAKER_TRIGGERED").select(F.to_date("timestamp").alias("date"), "event_type"), f"SELECT date, 'CIRCUIT_BREAKER_TRIGGERED' AS event_type FROM ({_SQL['breaker_latch']}) WHERE tripped")

# streaming
def stored(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote."""
    root = M.scratch(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


add("quote_stream_dedup", lambda s, d: stored(Q.deduplicated(Q.events(s, d)).select(F.unix_micros("time").alias("time_us"), "symbol")), f"{O.QUOTES} SELECT DISTINCT epoch_us(time) AS time_us, symbol FROM valid")
add("quote_bars_tumbling", lambda s, d: Q.bars(M.raw_quotes(s, d)).withColumn("time", F.unix_micros("time")), f"{O.QUOTES} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, time)) AS time, symbol, min_by(mid, event_id) AS open, max(mid) AS high, min(mid) AS low, max_by(mid, event_id) AS close, count(*) AS ticks FROM valid GROUP BY 1, 2", "open high low close")


def nav_latch_stream(s: SparkSession, d: str) -> DataFrame:
    raw = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    rows = raw.select(F.col("event_type").alias("portfolio"), F.col("event_id").alias("at"), (1e6 + F.col("value") * 500).alias("nav"), (F.col("event_id") % 97 == 0).alias("reset"))
    return stored(Q.latch(rows))


add("nav_latch_stream", nav_latch_stream)
def modelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = clean(s, d)
    return M.written(I.matrix(c)), c


def ml_log(s: SparkSession, d: str) -> store.Log:
    """The signal table of all splits, its models' importances beside it."""
    log = L.signal_log(s, M.scratch(s))
    L.walk_forward(*modelled(s, d), log, trees=20, depth=5)
    return log


def ml_composite(s: SparkSession, d: str) -> DataFrame:
    """The composite with its third term, from the signal table."""
    matrix, c = modelled(s, d)
    log = L.signal_log(s, M.scratch(s))
    return S.composite(matrix, L.walk_forward(matrix, c, log, trees=20, depth=5))


add("ml_walk_forward", lambda s, d: L.signals_of(ml_log(s, d)))
add("top_features", lambda s, d: S.top_features(L.importances_of(ml_log(s, d))))
add("ml_composite", ml_composite)
add("look_ahead", lambda s, d: look_ahead(clean(s, d), I.features, [c for c in I.PER_TICKER]))
add("random_signals", lambda s, d: S.random_signals(clean(s, d)))
add("synthetic_bars", lambda s, d: M.synthetic_bars(s, TICKERS, "2018-01-01", "2024-12-31"))
add("synthetic_factors", lambda s, d: M.synthetic_factors(s, "2018-01-01", "2024-12-31"))


# sources and sinks of their own
def history(s: SparkSession, d: str) -> DataFrame:
    """Bars through the history source, written once, a folder a ticker."""
    path = M.scratch(s)
    store.write_sorted(bars(s, d), path)
    tickers = [r.ticker for r in s.read.parquet(path).select("ticker").distinct().orderBy("ticker").collect()]
    return feed.history(s, path, [*tickers, "ATLANTIS"])


add("history_source", lambda s, d: history(s, d).where("error is null and ticker != 'ASIA' and date >= date'1995-01-01'").drop("error"), f"{O.BARS} SELECT * FROM bars WHERE ticker != 'ASIA' AND date >= DATE '1995-01-01'", "open high low close")
add("history_report", lambda s, d: feed.report(M.written(history(s, d))).withColumn("error", F.lit(None).cast("string")), f"{O.BARS} SELECT ticker, count(*) AS bars, false AS failed, CAST(NULL AS VARCHAR) AS error FROM bars GROUP BY 1 UNION ALL SELECT 'ATLANTIS', 0, true, NULL")


def quote_feed(s: SparkSession, d: str) -> DataFrame:
    """Valid quotes through the feed, whose second half is published after the stream has stopped; it goes on from its checkpoint."""
    root, raw = M.scratch(s), M.raw_quotes(s, d)
    for number, part in enumerate((raw.where("event_id % 2 = 0"), raw.where("event_id % 2 != 0")), 1):
        feed.publish(part, f"{root}/feed", number)
        stream = Q.valid(feed.quotes(s, f"{root}/feed"))
        out = feed.drained(stream, f"{root}/rows", f"{root}/state")
    return out.select("event_id", F.unix_micros("time").alias("time_us"), "symbol", "bid", "ask", "mid", "spread_bps")


add("quote_feed", quote_feed, f"{O.QUOTES} SELECT event_id, epoch_us(time) AS time_us, symbol, bid, ask, mid, spread_bps FROM valid", "bid ask mid spread_bps")


def quote_upsert(s: SparkSession, d: str) -> DataFrame:
    """Valid quotes upserted by day in two overlapping batches, the second of them twice; the first writer of a key wins."""
    path = M.scratch(s)
    rows = quotes(s, d).select("time", "symbol", "mid", F.to_date("time").alias("day"))
    late = rows.where("dayofmonth(day) > 10").withColumn("mid", F.col("mid") + 1)
    for batch in (rows.where("dayofmonth(day) <= 20"), late, late):
        store.merge(s, path, batch, ["time", "symbol"])
    return s.read.parquet(path).select(F.unix_micros("time").alias("time_us"), "symbol", "mid")


add("quote_upsert", quote_upsert, f"{O.QUOTES} SELECT epoch_us(time) AS time_us, symbol, min(mid) + CASE WHEN day(time) > 20 THEN 1 ELSE 0 END AS mid FROM valid GROUP BY time, symbol", "mid")


def bars_window(s: SparkSession, d: str) -> DataFrame:
    """The 20-day mean close of two tickers in one year, from bars laid out by ticker and date: its lookback is read, nothing before."""
    path = M.scratch(s)
    store.write_sorted(bars(s, d), path)
    made = lambda rows: rows.select("date", "ticker", R.mean("close", 20).alias("sma_20"))
    return store.windowed(s, path, "1996-01-01", "1996-12-31", 200, made, ["ASIA", "EUROPE"])


add("bars_window", bars_window, f"{O.BARS} SELECT date, ticker, sma_20 FROM (SELECT date, ticker, {O.mean('close', 20)} AS sma_20 FROM bars) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND ticker IN ('ASIA', 'EUROPE')", "sma_20")


def risk_log(s: SparkSession, d: str) -> DataFrame:
    """Events of the breaker and the position limits in one log, the limits' run repeated; counted by type and reason from 1993 on."""
    log = store.Log(s, M.scratch(s), "timestamp timestamp, event_type string")
    limits = K.position_limits(orders(s, d).join(ledger(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), held(s, d), M.sectors(s)).where("limit_reason != 'OK'")
    limits = limits.select(F.col("date").cast("timestamp").alias("timestamp"), F.lit("ORDER_REJECTED").alias("event_type"), F.create_map(F.lit("symbol"), "symbol", F.lit("reason"), "limit_reason").alias("details"))
    for run, rows in (("breaker", K.risk_events(K.breaker(nav(s, d)))), ("limits", limits), ("limits", limits)):
        log.append(rows, run)
    return K.filtered(log.read(), since="1993-01-01").groupBy("event_type", F.coalesce(F.col("details")["reason"], F.lit("DRAWDOWN")).alias("reason")).agg(F.count("*").alias("n"), F.min(F.to_date("timestamp")).alias("first"))


add("risk_log", risk_log, f"SELECT event_type, reason, count(*) AS n, min(date) AS first FROM (SELECT date, 'CIRCUIT_BREAKER_TRIGGERED' AS event_type, 'DRAWDOWN' AS reason FROM ({_SQL['breaker_latch']}) WHERE tripped UNION ALL SELECT CAST(l_shipdate AS DATE), 'ORDER_REJECTED', limit_reason FROM ({_SQL['position_limits']}) p JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE limit_reason != 'OK') WHERE date >= DATE '1993-01-01' GROUP BY 1, 2")


def quality_gate(s: SparkSession, d: str) -> DataFrame:
    """What a gated write of the bars counts on its way."""
    low, high = F.least("open", "close"), F.greatest("open", "close")
    hard = {"no_close": F.col("close").isNull(), "negative": F.least("open", "high", "low", "close") < 0, "inconsistent": (F.col("high") < high) | (F.col("low") > low)}
    soft = {"thin": F.col("volume") < 5 * config.MIN_DAILY_VOLUME, "flat": F.col("high") == F.col("low")}
    seen = store.gated(bars(s, d), M.scratch(s), hard, soft)
    return s.createDataFrame([(k, int(v)) for k, v in seen.items()], "measure string, n long")


add("quality_gate", quality_gate, f"{O.BARS} SELECT 'rows' AS measure, count(*) AS n FROM bars UNION ALL SELECT 'thin', count(*) FILTER (volume < {5 * config.MIN_DAILY_VOLUME}) FROM bars UNION ALL SELECT 'flat', count(*) FILTER (high = low) FROM bars")


def breaker_stream(s: SparkSession, d: str) -> DataFrame:
    """NAVs, resets and orders of a portfolio for each event type, in files that cut times at random, answered in the order of time."""
    root, raw = M.scratch(s), M.read(s, d, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "reset").when(F.col("event_id") % 7 == 0, "order").otherwise("nav")
    rows = raw.select(F.col("event_type").alias("portfolio"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "nav", 1e6 + F.col("value") * 500).alias("nav"))
    end = rows.agg((F.max("time") + F.expr("interval 2 days")).alias("time")).select(F.lit("").alias("portfolio"), "time", F.lit(0).cast("long").alias("seq"), F.lit("nav").alias("kind"), F.lit(1.0).alias("nav"))
    rows.repartition(2, "seq").write.parquet(f"{root}/in")
    stream = s.readStream.schema(breaker.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    span = "400 days"  # files hold rows of all times, so nothing is late
    end.withColumn("time", F.col("time") + F.expr(f"interval {span}")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    out = feed.drained(breaker.answered(stream, span), f"{root}/rows", f"{root}/state")
    return out.where("portfolio != ''").select("portfolio", F.unix_micros("time").alias("time_us"), "seq", "kind", "drawdown", "halted", "allowed")


add("breaker_stream", breaker_stream, f"""SELECT portfolio, time_us, seq, kind, (nv - peak) / peak AS drawdown, halted, CASE WHEN kind = 'order' THEN NOT halted END AS allowed FROM (
 SELECT *, coalesce(bool_or(kind = 'nav' AND (nv - peak) / peak < -{config.DRAWDOWN_LIMIT}) OVER (PARTITION BY portfolio, era ORDER BY time_us, k, seq), false) AS halted FROM (
 SELECT *, count(*) FILTER (kind = 'reset') OVER w AS era, last_value(nav IGNORE NULLS) OVER w AS nv, max(nav) OVER w AS peak FROM (
 SELECT event_type AS portfolio, epoch_us(CAST(ts AS TIMESTAMP)) AS time_us, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'reset' WHEN event_id % 7 = 0 THEN 'order' ELSE 'nav' END AS kind,
 CASE WHEN event_id % 97 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS k, CASE WHEN event_id % 97 = 0 OR event_id % 7 = 0 THEN NULL ELSE 1e6 + value * 500 END AS nav FROM events)
 WINDOW w AS (PARTITION BY portfolio ORDER BY time_us, k, seq)))""", "drawdown")


def price_fill(s: SparkSession, d: str) -> DataFrame:
    """Clean bars of bars whose prices are missing on runs of one to six days: three are filled, the rest goes."""
    gap = (F.dayofmonth("date") % 8 < 2) | (F.dayofmonth("date") > 24)
    holed = bars(s, d).withColumns({c: F.when(~gap, F.col(c)) for c in ("open", "high", "low", "close")})
    return P.clean(holed).select("date", "ticker", "open", "close", ret())


_HOLED = f"""{O.BARS}, holed AS (SELECT date, ticker, volume, {", ".join(f"CASE WHEN NOT (day(date) % 8 < 2 OR day(date) > 24) THEN {c} END AS {c}" for c in ("open", "close"))} FROM bars),
 filled AS (SELECT date, ticker, volume, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in ("open", "close"))} FROM holed)"""
add("price_fill", price_fill, f"{_HOLED} SELECT * FROM (SELECT date, ticker, open, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM filled WHERE close IS NOT NULL AND volume > 0) WHERE ret IS NOT NULL", "open close ret")


def quote_bars_stream(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars of a stream with a watermark; a last tick long after the others closes every window and is in none that comes out."""
    root, raw = M.scratch(s), M.raw_quotes(s, d)
    end = raw.agg((F.max("time") + F.expr("interval 30 days")).alias("time")).select(F.lit(-1).cast("long").alias("event_id"), "time", F.lit("end").alias("symbol"), F.lit(1.0).alias("bid"), F.lit(1.0).alias("ask"))
    for number, part in enumerate((raw, end, end.withColumn("time", F.col("time") + F.expr("interval 1 day"))), 1):
        feed.publish(part, f"{root}/feed", number)
        out = feed.drained(Q.bars(feed.quotes(s, f"{root}/feed"), delay="5 minutes"), f"{root}/rows", f"{root}/state")
    return out.withColumn("time", F.unix_micros("time"))


add("quote_bars_stream", lambda s, d: quote_bars_stream(s, d).where("symbol != 'end'"), _SQL["quote_bars_tumbling"], "open high low close")


def ensemble_pipeline(s: SparkSession, d: str) -> DataFrame:
    """The picks of the ensemble's run, from its sink, with the number of rows of the others."""
    c = clean(s, d)
    out = books.ensemble(M.scratch(s), M.written(I.matrix(c)), c)
    counts = [out[name].agg(F.count("*").alias(name)) for name in ("composite", "ranked", "ic")]
    return out["long_short"].join(counts[0]).join(counts[1]).join(counts[2]).select("date", "ticker", "position", "composite", "ranked", "ic")


add("ensemble_pipeline", ensemble_pipeline, f"SELECT date, ticker, position, (SELECT count(*) FROM ({_SQL['composite_signal']})) AS composite, (SELECT count(*) FROM ({_SQL['ranked_signal']})) AS ranked, {len(S.HORIZONS)} AS ic FROM ({_SQL['long_short']})")


def covariance_cached(s: SparkSession, d: str) -> DataFrame:
    """The covariance, made once and then read, since the tables' files are the same."""
    root, inputs = M.scratch(s), [f"{d}/{t}.parquet" for t in ("lineitem", "part", "supplier", "nation", "region")]
    books.covariance(s, root, inputs, lambda: clean(s, d))
    return books.covariance(s, root, inputs, lambda: clean(s, d).limit(0))


add("covariance_cached", covariance_cached, _SQL["covariance"], "cov", 9)


def ledger_log(s: SparkSession, d: str) -> DataFrame:
    """P&L of a ledger to which the fills of each month were recorded, those of one month again."""
    book, path = books.Ledger(s, M.scratch(s)), M.scratch(s)
    fills = ledger(s, d).select(*(c.split()[0] for c in books.FILLS.split(", ")), F.month("date").alias("month"))
    M.write_parquet(fills, path, "month")  # joined once: each run would broadcast the dimensions anew
    fills = s.read.schema(fills.schema).parquet(path)
    for month in (*range(1, 13), 5):
        book.record(fills.where(F.col("month") == month).drop("month"), f"month-{month:02d}")
    return book.pnl()


add("ledger_log", ledger_log, _SQL["ledger_pnl"], "gross_pnl total_impact_cost total_commission net_pnl", 3)
add("walk_forward_text", lambda s, d: books.walk_forward_text(B.walk_forward(*traded(s, d)), B.sharpe(F.col("ret"))))
add("ohlcv_json", lambda s, d: books.envelope(bars(s, d).select(F.col("ticker").alias("symbol"), F.col("date").cast("string").alias("time"), F.col("close").cast("int").alias("close"), "volume"), ["symbol"], ["time"], 30, days=30),
    f"""{O.BARS}, n AS (SELECT ticker, strftime(date, '%Y-%m-%d') AS t, CAST(trunc(close) AS INTEGER) AS c, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars)
 SELECT ticker AS symbol, '{{"symbol":"' || ticker || '","days":30,"count":' || count(*) || ',"data":[' || string_agg('{{"time":"' || t || '","close":' || c || ',"volume":' || volume || '}}', ',' ORDER BY t) || ']}}' AS json FROM n WHERE k <= 30 GROUP BY ticker""")  # fmt: skip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

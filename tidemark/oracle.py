"""Building blocks of the DuckDB SQL that the market queries are held against."""

BARS = """bars AS MATERIALIZED (SELECT CAST(l_shipdate AS DATE) AS date, r_name AS ticker, min_by(p_retailprice, o) AS open, max(p_retailprice) AS high, min(p_retailprice) AS low,
 max_by(p_retailprice, o) AS close, CAST(sum(l_quantity) * 1000 AS BIGINT) AS volume
 FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY 1, 2)"""
CLEAN = BARS + """, clean AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM (SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS log_return, close * volume AS dollar_volume
 FROM bars WHERE close IS NOT NULL AND volume > 0 WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE ret IS NOT NULL)"""
CALENDAR = """days AS (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM bars) WHERE dayofweek(d) BETWEEN 1 AND 5)"""
LEDGER = """ledger AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r_name AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS quantity,
 p_retailprice * (1 + (l_tax - l_discount) / 100) AS price, p_retailprice AS expected_price, (l_tax - l_discount) * 100 AS market_impact_bps, 0.005::DOUBLE * l_quantity AS commission, CAST(l_shipdate AS DATE) AS date
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
QUOTES = """quotes AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS time, event_type AS symbol, value - 0.5 AS bid, value + (event_id % 5) * 0.25::DOUBLE - 0.25 AS ask FROM events),
valid AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 1e4 AS spread_bps FROM quotes WHERE coalesce(bid, 0) > 0 AND coalesce(ask, 0) > 0 AND ask >= bid)"""


def rolled(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def mean(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rolled(n)} >= {n} THEN avg({x}) OVER {rolled(n)} END"


def deviation(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rolled(n)} >= {n} THEN stddev_samp({x}) OVER {rolled(n)} END"


def zscore(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rolled(n)} >= {n} AND stddev_samp({x}) OVER {rolled(n)} > 0 THEN ({x} - avg({x}) OVER {rolled(n)}) / stddev_samp({x}) OVER {rolled(n)} END"


def average_rank(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE END"


def ema(name: str, n: int, source: str = "clean", x: str = "close") -> str:
    """A recursive table (ticker, rn, v) over a source numbered by rn from 1 on."""
    a = f"(2.0::DOUBLE / {n + 1})"
    return f"{name} AS (SELECT ticker, rn, CAST({x} AS DOUBLE) AS v FROM {source} WHERE rn = 1 UNION ALL SELECT s.ticker, s.rn, {a} * s.{x} + (1 - {a}) * e.v FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"


EMA20 = ema("e20", 20)
MACD = ", ".join((ema("e12", 12), ema("e26", 26), "ml AS MATERIALIZED (SELECT c.ticker, c.date, c.rn - 25 AS rn, e12.v - e26.v AS line FROM clean c JOIN e12 USING (ticker, rn) JOIN e26 USING (ticker, rn) WHERE c.rn >= 26)", ema("sg", 9, "ml", "line"), "macd AS (SELECT ml.ticker, ml.date, line AS macd_line, CASE WHEN rn >= 9 THEN v END AS macd_signal, CASE WHEN rn >= 9 THEN line - v END AS macd_hist FROM ml JOIN sg USING (ticker, rn))"))
RSI = """moves AS MATERIALIZED (SELECT ticker, rn, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM (SELECT ticker, rn, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS d FROM clean) WHERE rn >= 2),
wr AS (SELECT ticker, 15::BIGINT AS rn, avg(g) AS ag, avg(l) AS al FROM moves WHERE rn <= 15 GROUP BY ticker HAVING count(*) = 14 UNION ALL
 SELECT m.ticker, m.rn, (wr.ag * 13 + m.g) / 14, (wr.al * 13 + m.l) / 14 FROM wr JOIN moves m ON m.ticker = wr.ticker AND m.rn = wr.rn + 1),
rsi AS (SELECT c.ticker, c.date, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM wr JOIN clean c USING (ticker, rn))"""
ATR = """ranges AS MATERIALIZED (SELECT ticker, rn, CASE WHEN before IS NULL THEN high - low ELSE greatest(high - low, abs(high - before), abs(low - before)) END AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM clean)),
wa AS (SELECT ticker, 14::BIGINT AS rn, avg(tr) AS v FROM ranges WHERE rn <= 14 GROUP BY ticker HAVING count(*) = 14 UNION ALL SELECT r.ticker, r.rn, (wa.v * 13 + r.tr) / 14 FROM wa JOIN ranges r ON r.ticker = wa.ticker AND r.rn = wa.rn + 1),
atr AS (SELECT c.ticker, c.date, v AS atr_14 FROM wa JOIN clean c USING (ticker, rn) WHERE rn > 14)"""
ALPHA2 = f"""xy AS (SELECT *, round(ln(volume) - lag(ln(volume), 2) OVER (PARTITION BY ticker ORDER BY date), 12) AS x, round((close - open) / open, 12) AS y FROM clean),
rk AS (SELECT *, {average_rank("x", "ticker")} AS rx, CASE WHEN x IS NOT NULL THEN {average_rank("y", "ticker")} END AS ry FROM xy),
a2 AS (SELECT ticker, date, CASE WHEN count(rx) OVER {rolled(6)} >= 3 AND stddev_pop(rx) OVER {rolled(6)} * stddev_pop(ry) OVER {rolled(6)} > 0
 THEN -covar_pop(rx, ry) OVER {rolled(6)} / (stddev_pop(rx) OVER {rolled(6)} * stddev_pop(ry) OVER {rolled(6)}) END AS alpha_002 FROM rk)"""
UNION_VOLATILITY = f"""spine AS (SELECT date, ticker FROM (SELECT DISTINCT date FROM clean), (SELECT DISTINCT ticker FROM clean)),
uv AS (SELECT date, ticker, {deviation("ret", 20)} AS uvol FROM spine LEFT JOIN clean USING (date, ticker))"""
RANKS = f"""rk3 AS (SELECT c.date, c.ticker, {average_rank("ret", "date")} AS a, {average_rank("uvol", "date")} AS b, {average_rank("rsi_14", "date")} AS c FROM clean c LEFT JOIN uv USING (date, ticker) LEFT JOIN rsi USING (date, ticker)),
nn AS (SELECT count(DISTINCT ticker) AS n FROM clean),
cs AS (SELECT date, ticker, 2 * (a - 1) / (n - 1) - 1 AS cs_rank_returns, 2 * (b - 1) / (n - 1) - 1 AS cs_rank_volatility, 2 * (c - 1) / (n - 1) - 1 AS cs_rank_rsi FROM rk3, nn)"""
MATRIX = f"""{CLEAN}, {EMA20}, {MACD}, {RSI}, {ATR}, {ALPHA2}, {UNION_VOLATILITY}, {RANKS},
wide AS (SELECT c.*, rsi_14, CASE WHEN dollar_volume <> 0 THEN abs(ret) / (dollar_volume + 1e-9) END AS am FROM clean c LEFT JOIN rsi USING (ticker, date)),
roll AS (SELECT ticker, date, rn, {mean("close", 20)} AS sma_20, {mean("close", 50)} AS sma_50, {deviation("close", 20)} AS sd, sign(ret - lag(ret) OVER w) * -(close - lag(close) OVER w) AS alpha_001,
 sign(volume - lag(volume) OVER w) * -(close - lag(close) OVER w) AS alpha_012, close / ({mean("close", 20)}) - 1 AS price_to_sma_20, {deviation("ret", 20)} AS volatility_20, volume / ({mean("volume", 20)}) AS volume_ratio_20,
 {mean("am", 21)} AS amihud_illiquidity, {zscore("ret", 60)} AS zscore_returns, CASE WHEN count(ret) OVER {rolled(60)} >= 60 THEN skewness(ret) OVER {rolled(60)} END AS skewness_returns, CASE WHEN count(ret) OVER {rolled(60)} >= 60 THEN kurtosis(ret) OVER {rolled(60)} END AS kurtosis_returns,
 {zscore("rsi_14", 60)} AS zscore_rsi, rsi_14 FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY date)),
every AS (SELECT r.date, r.ticker, sma_20, sma_50, CASE WHEN r.rn >= 20 THEN e20.v END AS ema_20, r.rsi_14, macd_line, macd_signal, macd_hist, sma_20 + 2 * sd AS bb_upper_20, sma_20 AS bb_mid_20, sma_20 - 2 * sd AS bb_lower_20, atr_14, alpha_001, alpha_002, alpha_012, price_to_sma_20, volatility_20, volume_ratio_20,
 cs_rank_returns, cs_rank_volatility, cs_rank_rsi, amihud_illiquidity, zscore_returns, skewness_returns, kurtosis_returns, zscore_rsi
 FROM roll r JOIN e20 USING (ticker, rn) LEFT JOIN macd USING (ticker, date) LEFT JOIN atr USING (ticker, date) LEFT JOIN a2 USING (ticker, date) LEFT JOIN cs USING (ticker, date)),
matrix AS MATERIALIZED (SELECT * FROM every WHERE sma_50 IS NOT NULL AND ema_20 IS NOT NULL AND rsi_14 IS NOT NULL AND macd_signal IS NOT NULL AND atr_14 IS NOT NULL AND alpha_001 IS NOT NULL AND alpha_002 IS NOT NULL AND alpha_012 IS NOT NULL
 AND volatility_20 IS NOT NULL AND cs_rank_returns IS NOT NULL AND cs_rank_volatility IS NOT NULL AND cs_rank_rsi IS NOT NULL AND amihud_illiquidity IS NOT NULL AND zscore_returns IS NOT NULL AND skewness_returns IS NOT NULL AND kurtosis_returns IS NOT NULL AND zscore_rsi IS NOT NULL)"""
SIGNAL = MATRIX + ", sig AS MATERIALIZED (SELECT date, ticker, greatest(-1, least(1, 0.5 * cs_rank_returns + 0.5 * CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END))::DOUBLE AS signal FROM matrix)"
STRATEGY = SIGNAL + """, nt AS (SELECT count(DISTINCT ticker) AS n FROM sig), pos AS (SELECT date, ticker, signal, lag(signal) OVER (PARTITION BY ticker ORDER BY date) AS position FROM sig),
strat AS MATERIALIZED (SELECT p.date, p.ticker, signal, position, close, position * ret AS gross, abs(position - lag(position) OVER (PARTITION BY p.ticker ORDER BY p.date)) AS change FROM pos p JOIN clean USING (date, ticker))"""


def net(bps: str) -> str:
    return f"gross - coalesce(change * ({bps} / 1e4 * close + 0.005) / nullif(abs(position) * close, 0), 0)"


DAILY = STRATEGY + f", dr AS MATERIALIZED (SELECT date, sum(coalesce(({net('10.0')}) / n, 0)) AS ret FROM strat, nt GROUP BY 1)"
EQUITY = DAILY + ", eq AS MATERIALIZED (SELECT date, ret, equity, max(equity) OVER (ORDER BY date) AS peak, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT date, ret, 1000000 * product(1 + ret) OVER (ORDER BY date) AS equity FROM dr))"
COVARIANCE = CLEAN + """, lastd AS (SELECT DISTINCT date FROM clean ORDER BY date DESC LIMIT 60), rec AS (SELECT c.* FROM clean c JOIN lastd USING (date)), ok AS (SELECT ticker FROM rec GROUP BY 1 HAVING count(ret) >= 30),
cov AS MATERIALIZED (SELECT a.ticker AS t1, b.ticker AS t2, covar_samp(a.ret, b.ret) AS cov FROM rec a JOIN rec b USING (date) WHERE a.ticker IN (FROM ok) AND b.ticker IN (FROM ok) AND (SELECT count(*) FROM ok) >= 2 GROUP BY 1, 2)"""
SPLITS = "ord AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {rows})), nd AS (SELECT count(*) AS n FROM ord), sp AS (SELECT k AS split, k * 63 AS train_start, k * 63 + {train} AS train_end, k * 63 + 252 AS test_start, k * 63 + 315 AS test_end FROM nd, unnest(generate_series(0, CASE WHEN n >= 315 THEN (n - 315) // 63 ELSE -1 END)) AS u(k))"
SECTORS = "sectors(ticker, sector) AS (VALUES ('AMERICA', 'West'), ('EUROPE', 'West'), ('ASIA', 'East'), ('AFRICA', 'East'))"

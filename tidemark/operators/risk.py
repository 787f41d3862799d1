"""Portfolio risk: VaR and CVaR, pre-trade gates, drawdown breaker, position limits, factor regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config


def holdings(rows: DataFrame, each: float | None = None) -> DataFrame:
    """(ticker, weight): the same for all, 1/N unless given."""
    n = rows.select("ticker").distinct()
    return n.withColumn("weight", F.lit(each) if each is not None else 1 / F.count("*").over(Window.partitionBy()))


def _form(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: q, the quadratic form of the weights that have a covariance, and their total."""
    known = weights.join(cov.select(F.col("t1").alias("ticker")).distinct(), "ticker")
    q = cov.join(F.broadcast(known.select(F.col("ticker").alias("t1"), F.col("weight").alias("w1"))), "t1").join(F.broadcast(known.select(F.col("ticker").alias("t2"), F.col("weight").alias("w2"))), "t2")
    return q.agg(F.sum(F.col("w1") * F.col("w2") * F.col("cov")).alias("q")).join(known.agg(F.sum("weight").alias("total")))


def normalised(total: Column) -> Column:
    return F.when(F.abs(total - 1) > 1e-6, total).otherwise(1.0)


def parametric_var(cov: DataFrame, weights: DataFrame, value: float = config.INITIAL_CAPITAL, horizon: int = 1) -> DataFrame:
    """(sigma, var, cvar, var_percent): VaR positive, CVaR negative, no mean."""
    sigma = F.sqrt(F.greatest(F.col("q"), F.lit(0.0))) / normalised(F.col("total"))
    out = _form(cov, weights).select(sigma.alias("sigma"))
    s = F.col("sigma") * horizon**0.5
    return out.select("sigma", (config.Z95 * s * value).alias("var"), (-s * config.PDF95 / (1 - config.CONFIDENCE) * value).alias("cvar"), (config.Z95 * s).alias("var_percent"))


def historical_cvar(returns: DataFrame, confidence: float = config.CONFIDENCE) -> DataFrame:
    """(cvar): minus the mean of returns up to their lower quantile; 0 for fewer than ten."""
    q = returns.agg(F.percentile("ret", F.lit(1 - confidence)).alias("q"), F.count("ret").alias("n"))
    out = returns.join(F.broadcast(q)).agg(F.max("n").alias("n"), (-F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret")))).alias("c"))
    return out.select(F.when(F.col("n") >= 10, F.col("c")).otherwise(0.0).alias("cvar"))


def var_gate(orders: DataFrame, cov: DataFrame, weights: DataFrame, value: float = config.INITIAL_CAPITAL) -> DataFrame:
    """orders (symbol, side, quantity, price, ...) with var_percent, approved and reason, each against the same holdings.

    With d the order's share of the portfolio, the form of the new weights is q + 2 d (Sw)_s + d^2 S_ss, so an order needs
    two numbers of its symbol and none of the others.
    """
    w = weights.select(F.col("ticker").alias("t2"), F.col("weight").alias("w2"))
    own = cov.join(F.broadcast(w), "t2", "left").groupBy(F.col("t1").alias("symbol")).agg(F.sum(F.col("cov") * F.coalesce("w2", F.lit(0.0))).alias("sw"), F.max(F.when(F.col("t1") == F.col("t2"), F.col("cov"))).alias("ss"))
    rows = orders.join(F.broadcast(own), "symbol", "left").join(F.broadcast(weights.select(F.col("ticker").alias("symbol"), "weight")), "symbol", "left").join(F.broadcast(_form(cov, weights)))
    worth = F.col("quantity") * F.col("price")
    d = F.when(F.col("side") == "BUY", worth / value).otherwise(-worth / value)
    held = F.coalesce("weight", F.lit(0.0))
    total = F.col("total") + d
    form = F.col("q") + 2 * d * F.col("sw") + d * d * F.col("ss")
    new = F.when(total > 0, config.Z95 * F.sqrt(F.greatest(form, F.lit(0.0))) / normalised(total))
    reason = F.when((F.col("side") == "BUY") & (worth > value * 0.5), "ORDER_VALUE").when(F.col("ss").isNull(), "NO_COVARIANCE").when((F.col("side") != "BUY") & (held - worth / value < 0), "SELL_EXCEEDS_HOLDING").when(F.abs(new) > config.VAR_LIMIT, "VAR_LIMIT").otherwise("OK")
    out = rows.withColumn("reason", reason).withColumn("approved", F.col("reason") == "OK")
    return out.withColumn("var_percent", F.when(F.col("reason").isin("OK", "VAR_LIMIT"), new)).select(*orders.columns, "var_percent", "reason", "approved")


def breaker(nav: DataFrame, limit: float = config.DRAWDOWN_LIMIT) -> DataFrame:
    """nav (date, nav, reset boolean) with drawdown, tripped and halted: halted from the first drawdown beyond the limit
    until a reset; a reset keeps the peak, so the next update may trip again."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = nav.withColumn("peak", F.max("nav").over(w)).withColumn("drawdown", (F.col("nav") - F.col("peak")) / F.col("peak"))
    rows = rows.withColumn("tripped", F.col("drawdown") < -limit).withColumn("era", F.sum(F.col("reset").cast("int")).over(w))
    return rows.withColumn("halted", F.bool_or(F.col("tripped") & ~F.col("reset")).over(Window.partitionBy("era").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).drop("era")


def with_sector(rows: DataFrame, sectors: DataFrame, by: str = "ticker") -> DataFrame:
    """The dimension is a fixed list of a few tickers."""
    return rows.join(F.broadcast(sectors.withColumnRenamed("ticker", by)), by, "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))


def position_limits(orders: DataFrame, weights: DataFrame, sectors: DataFrame, nav: float = config.INITIAL_CAPITAL) -> DataFrame:
    """orders with limit_reason: stock, then sector (Other has none); the side doesn't matter."""
    by_sector = with_sector(weights, sectors).groupBy("sector").agg(F.sum("weight").alias("sector_weight"))
    rows = with_sector(orders, sectors, "symbol").join(F.broadcast(weights.withColumnRenamed("ticker", "symbol")), "symbol", "left").join(F.broadcast(by_sector), "sector", "left")
    d = F.col("quantity") * F.col("price") / nav
    reason = F.when(F.coalesce("weight", F.lit(0.0)) + d > config.STOCK_LIMIT, "STOCK_LIMIT").when((F.col("sector") != "Other") & (F.coalesce("sector_weight", F.lit(0.0)) + d > config.SECTOR_LIMIT), "SECTOR_LIMIT").otherwise("OK")
    return rows.withColumn("limit_reason", reason).select(*orders.columns, "sector", "limit_reason")


def sector_exposure(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    out = with_sector(weights, sectors).groupBy("sector").agg(F.sum("weight").alias("weight"), F.count("*").alias("tickers"), F.count_if(F.col("weight") > config.STOCK_LIMIT).alias("stock_breaches"))
    return out.withColumn("breach", (F.col("sector") != "Other") & (F.col("weight") > config.SECTOR_LIMIT))


def factor_ols(rows: DataFrame, factors: tuple[str, ...] = ("mkt", "smb", "hml")) -> DataFrame:
    """One row of OLS of y on a constant and the factors: alpha, betas, r2, adjusted r2, n, residual deviation; none under 30 rows.

    The sums of products are one aggregation; only their (k+1)^2 numbers reach the driver.
    """
    import numpy as np

    rows = rows.na.drop(subset=["y", *factors])
    x = [F.lit(1.0), *(F.col(f) for f in factors), F.col("y")]
    k = len(factors) + 1
    sums = rows.agg(*(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).first()
    names = ["alpha", *(f"beta_{f}" for f in factors), "r_squared", "adj_r_squared", "resid_std"]
    schema = ", ".join(f"{n} double" for n in names) + ", n long, alpha_annual double"
    n = int(sums[0] or 0)
    if n < 30:
        return rows.sparkSession.createDataFrame([], schema)
    g = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    b = np.linalg.solve(g[:k, :k], g[:k, k])
    rss, tss = g[k, k] - b @ g[:k, k], g[k, k] - g[0, k] ** 2 / n
    r2 = 1 - rss / tss
    adj = 1 - (1 - r2) * (n - 1) / (n - k)
    return rows.sparkSession.createDataFrame([(*map(float, b), float(r2), float(adj), float((rss / (n - k)) ** 0.5), n, float(b[0] * config.TRADING_DAYS))], schema)


def risk_events(latched: DataFrame) -> DataFrame:
    """Typed events from the breaker, details as a map."""
    return latched.where("tripped").select(F.col("date").cast("timestamp").alias("timestamp"), F.lit("CIRCUIT_BREAKER_TRIGGERED").alias("event_type"), F.create_map(F.lit("nav"), F.col("nav").cast("string"), F.lit("drawdown"), F.col("drawdown").cast("string")).alias("details"))


def filtered(events: DataFrame, event_type: str | None = None, since: str | None = None) -> DataFrame:
    """Risk events of a type, from a time on."""
    for value, test in ((event_type, F.col("event_type") == event_type), (since, F.col("timestamp") >= since)):
        if value is not None:
            events = events.where(test)
    return events


def approval(gated: DataFrame) -> DataFrame:
    """One row: orders, approved ones and their share."""
    n = F.count_if("approved")
    return gated.agg(F.count("*").alias("orders"), n.alias("approved"), (n / F.count("*")).alias("approval_rate"))

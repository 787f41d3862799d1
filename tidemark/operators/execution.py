"""Market impact, order routing, the trade ledger and positions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import rolling as R

#: Slippage of a fill as a part of its impact.
SLIPPAGE = 0.1


def impact(side: Column, quantity: Column, adv: Column, sigma: Column) -> Column:
    """Signed square-root impact; without volume an unsigned 10 bp per 10,000 shares, without volatility 2 %."""
    s = F.when(sigma > 0, sigma).otherwise(0.02)
    sized = s * F.sqrt(F.abs(quantity) / F.when(adv > 0, adv))
    return F.when(F.coalesce(adv, F.lit(0.0)) <= 0, 0.001 * (quantity / 10000)).when(side == "BUY", sized).otherwise(-sized)


def with_liquidity(orders: DataFrame, clean_bars: DataFrame) -> DataFrame:
    """orders (date, symbol, ...) with the symbol's average dollar volume and volatility of the bar before that date's."""
    known = clean_bars.select("date", "ticker", R.mean("dollar_volume", 20).alias("a"), R.deviation("return", 20).alias("s"))
    known = known.select("date", F.col("ticker").alias("symbol"), R.lag("a").alias("adv"), R.lag("s").alias("sigma"))
    return orders.join(known, ["date", "symbol"], "left")


def priced(orders: DataFrame, clean_bars: DataFrame) -> DataFrame:
    rows = with_liquidity(orders, clean_bars)
    rows = rows.withColumn("impact", impact(F.col("side"), F.col("quantity"), F.col("adv"), F.col("sigma")))
    return rows.withColumn("execution_price", F.col("expected_price") * (1 + F.col("impact")))


def pnl(fills: DataFrame) -> DataFrame:
    gross = F.sum(F.when(F.col("side") == "BUY", F.col("price") - F.col("expected_price")).otherwise(F.col("expected_price") - F.col("price")) * F.col("quantity"))
    out = fills.agg(gross.alias("g"), F.sum(F.col("market_impact_bps") * F.col("quantity") / 10000).alias("i"), F.sum("commission").alias("c"), F.sum("quantity").alias("v"), F.count("*").alias("num_trades"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(zero("g").alias("gross_pnl"), zero("i").alias("total_impact_cost"), zero("c").alias("total_commission"), (zero("g") - zero("i") - zero("c")).alias("net_pnl"), F.coalesce("v", F.lit(0)).alias("total_volume"), "num_trades")


def positions(fills: DataFrame, clean_bars: DataFrame) -> DataFrame:
    """Open positions with entry and current price, unrealised P&L and weight; the entry price where there is no bar."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    net = fills.groupBy("symbol").agg(F.sum(sign * F.col("quantity")).alias("quantity"), F.sum(sign * F.col("quantity") * F.col("price")).alias("cost")).where("quantity != 0")
    last = clean_bars.groupBy(F.col("ticker").alias("symbol")).agg(F.max_by("close", "date").alias("last"))
    rows = net.join(last, "symbol", "left").withColumn("entry", F.col("cost") / F.col("quantity")).withColumn("now", F.coalesce("last", "entry"))
    total = F.sum(F.col("quantity") * F.col("now")).over(Window.partitionBy())
    weight = F.when(total > 0, F.col("quantity") * F.col("now") / total * 100).otherwise(0.0)
    return rows.select("symbol", "quantity", F.round("entry", 2).alias("entry_price"), F.round("now", 2).alias("current_price"), F.round(F.col("quantity") * (F.col("now") - F.col("entry")), 2).alias("unrealized_pnl"), F.round(weight, 2).alias("weight_percent"))


def portfolio_summary(fills: DataFrame, clean_bars: DataFrame) -> DataFrame:
    held = positions(fills, clean_bars).agg(F.sum(F.col("quantity") * F.col("current_price")).alias("v"), F.sum(F.col("quantity") * F.col("entry_price")).alias("c"), F.count("*").alias("positions_count"))
    both = held.join(pnl(fills).select("gross_pnl"))
    u = F.col("v") - F.col("c")
    return both.select(F.round("v", 2).alias("nav"), F.round(u, 2).alias("unrealized_pnl"), F.round("gross_pnl", 2).alias("realized_pnl"), F.round(u + F.col("gross_pnl"), 2).alias("total_pnl"), "positions_count")


def daily_pnl(fills: DataFrame, capital: float = config.INITIAL_CAPITAL) -> DataFrame:
    """(date, pnl, equity) without the noise that the endpoint adds."""
    by_day = fills.groupBy("date").agg(F.sum((F.col("price") - F.col("expected_price")) * F.col("quantity")).alias("pnl"))
    return by_day.withColumn("equity", capital + F.sum("pnl").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def portfolio_risk(cov: DataFrame, equity: DataFrame, latched: DataFrame) -> DataFrame:
    """VaR from the mean covariance, the current drawdown in per cent, whether the breaker tripped on the last day."""
    v = cov.agg(F.round(1.645 * F.sqrt(F.greatest(F.avg("cov"), F.lit(0.0))) * 100, 2).alias("var_95_1d"))
    d = equity.agg(F.round((F.max_by("equity", "date") / F.max("equity") - 1) * 100, 2).alias("current_drawdown"))
    t = latched.agg(F.max_by("tripped", "date").alias("circuit_breaker_triggered"))
    return v.join(d).join(t).withColumn("drawdown_limit", F.lit(config.DRAWDOWN_LIMIT * 100))


def route(orders: DataFrame, cov: list[tuple[str, str, float]], sectors: dict[str, str], value: float = config.INITIAL_CAPITAL) -> DataFrame:
    """Each portfolio's orders one after the other: VaR gate, breaker, position limits, impact, commission, fill with slippage, and new weights for the next.

    orders: (portfolio, date, symbol, side, quantity, price, adv, sigma, halted, order keys); halted: the breaker stops the
    order. Weights move by the execution price; slippage is a tenth of the impact and isn't part of the price. An order's fate depends on the fills
    before it: portfolios are dealt to tasks and sorted there, and a task holds the weights of the portfolio it is at and a batch
    of its orders. A gate looks at one symbol's weight and covariances. cov is the covariance of the universe's symbols.
    """
    keys = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    made = ["portfolio", "l_orderkey", "l_linenumber", "symbol", "side", "quantity"]

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, at = None, object()
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                if book is None or r.portfolio != at:
                    book, at = Book(cov, sectors, value), r.portfolio
                out.append(book.order(r))
            yield part[made].assign(**{c: pd.Series([x[i] for x in out], dtype=object if c == "status" else float, index=part.index) for i, c in enumerate(("status", "fill_price", "commission", "slippage_bps"))})

    sorted_ = orders.withColumn("halted", F.coalesce("halted", F.lit(False))).repartition("portfolio").sortWithinPartitions("portfolio", *keys)
    return sorted_.select(*dict.fromkeys([*made, *keys, "price", "adv", "sigma", "halted"])).mapInPandas(routed, "portfolio string, l_orderkey long, l_linenumber int, symbol string, side string, quantity long, status string, fill_price double, commission double, slippage_bps double")


class Book:
    """A portfolio's weights, with the quadratic form of the covariance kept up to date fill by fill."""

    def __init__(self, cov: list[tuple[str, str, float]], sectors: dict[str, str], value: float):
        self.value, self.sectors = value, sectors
        self.column: dict[str, dict[str, float]] = {}
        for a, b, c in cov:
            self.column.setdefault(b, {})[a] = c
        self.weights: dict[str, float] = {}
        self.by_sector: dict[str, float] = {}
        self.total = self.form = 0.0
        self.product: dict[str, float] = {}  # of the covariance and the weights

    def decided(self, r) -> str:
        worth = r.quantity * r.price
        d = worth / self.value
        if r.side == "BUY" and worth > 0.5 * self.value:
            return "ORDER_VALUE"
        own = self.column.get(r.symbol)
        if own is None:
            return "NO_COVARIANCE"
        moved = d if r.side == "BUY" else -d
        held = self.weights.get(r.symbol, 0.0)
        if held + moved < 0:
            return "SELL_EXCEEDS_HOLDING"
        if self.total + moved > 0:
            form = self.form + 2 * moved * self.product.get(r.symbol, 0.0) + moved * moved * own.get(r.symbol, 0.0)
            if config.Z95 * math.sqrt(max(form, 0.0)) / (self.total + moved) > config.VAR_LIMIT:
                return "VAR_LIMIT"
        if r.halted:
            return "CIRCUIT_BREAKER"
        if held + d > config.STOCK_LIMIT:
            return "STOCK_LIMIT"
        mine = self.sectors.get(r.symbol, "Other")
        if mine != "Other" and self.by_sector.get(mine, 0.0) + d > config.SECTOR_LIMIT:
            return "SECTOR_LIMIT"
        return "FILLED"

    def order(self, r) -> tuple:
        """Its status, and of a fill the price, commission and slippage."""
        what = self.decided(r)
        if what != "FILLED":
            return what, None, None, None
        if not r.adv or math.isnan(r.adv) or r.adv <= 0:
            move = 0.001 * r.quantity / 10000
        else:
            sigma = r.sigma if r.sigma and not math.isnan(r.sigma) and r.sigma > 0 else 0.02
            move = sigma * math.sqrt(abs(r.quantity) / r.adv) * (1 if r.side == "BUY" else -1)
        price = r.price * (1 + move)
        d = r.quantity * price / self.value * (1 if r.side == "BUY" else -1)
        own = self.column[r.symbol]
        self.form += 2 * d * self.product.get(r.symbol, 0.0) + d * d * own.get(r.symbol, 0.0)
        for a, c in own.items():
            self.product[a] = self.product.get(a, 0.0) + d * c
        self.weights[r.symbol] = self.weights.get(r.symbol, 0.0) + d
        mine = self.sectors.get(r.symbol, "Other")
        self.by_sector[mine] = self.by_sector.get(mine, 0.0) + d
        self.total += d
        return what, price, config.COMMISSION * r.quantity, move * 10000 * SLIPPAGE

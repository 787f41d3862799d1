"""Books that persist: the trade ledger, the ensemble's tables, the covariance that knows its inputs, and responses as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..sources.store import Log, cached
from . import execution, prices, signals

#: Columns of a fill.
FILLS = "symbol string, side string, quantity long, price double, expected_price double, market_impact_bps double, commission double, date date"


class Ledger:
    """Fills in a log of runs: a run of orders that is repeated is recorded once."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, FILLS)

    def record(self, fills: DataFrame, run: str) -> bool:
        """False if that run's fills are there already."""
        return self.log.append(fills, run)

    def load(self, encoded: str, run: str = "bootstrap") -> bool:
        """Records the fills of a base64-encoded CSV with a header, as a run of its own."""
        spark = self.log.spark
        text = F.replace(F.decode(F.unbase64("encoded"), "utf-8"), F.lit("\r"), F.lit(""))
        lines = spark.createDataFrame([(encoded,)], "encoded string").select(F.split(text, "\n").alias("l"))
        rows = lines.select(F.posexplode("l").alias("n", "line"), F.col("l")[0].alias("header")).where("n > 0 and line != ''")
        names = [n.strip() for n in rows.select("header").limit(1).first()[0].split(",")] if not rows.isEmpty() else []
        kinds = {c.split()[0]: c.split()[1] for c in FILLS.split(", ")}
        parsed = rows.select(F.from_csv("line", ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).alias("f")) if names else None
        fills = spark.createDataFrame([], FILLS) if parsed is None else parsed.select(*(F.col("f")[c].alias(c) if c in names else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
        return self.record(fills, run)

    def fills(self) -> DataFrame:
        return self.log.read()

    def pnl(self) -> DataFrame:
        return execution.pnl(self.fills())


def covariance(spark: SparkSession, root: str, inputs: list[str], clean_bars, window: int = 60, least: int = 30) -> DataFrame:
    """The covariance of clean_bars() (called only if needed), read from root while neither the input files nor the parameters change."""
    return cached(spark, root, inputs, {"what": "covariance", "window": window, "least": least}, lambda: prices.covariance(clean_bars(), window, least))


def ensemble(root: str, matrix: DataFrame, clean_bars: DataFrame, ml: DataFrame | None = None, weights: dict[str, float] | None = None, k: int = 2) -> dict[str, DataFrame]:
    """The composite, its ranks, the long/short picks and the ranks' information coefficients, each written below root once and read back for the next."""
    spark, out = matrix.sparkSession, {}

    def sink(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
        return out[name]

    composite = sink("composite", signals.composite(matrix, ml, weights))
    ranked = sink("ranked", signals.rank_signals(composite))
    sink("long_short", signals.long_short(ranked, k))
    sink("ic", signals.ic_decay(ranked.withColumnRenamed("ranked_signal", "signal"), clean_bars))
    return out


def walk_forward_text(returns: DataFrame, sharpe: Column) -> DataFrame:
    """(n, line): overall lines of a walk-forward's (split, date, ret), then one a split in order; numbers as text."""
    split = returns.groupBy("split").agg(F.min("date").alias("first"), F.max("date").alias("last"), sharpe.alias("s"))
    lines = split.select((F.col("split") + 3).cast("int").alias("n"), F.format_string("split %d: %s to %s, Sharpe %.3f", F.col("split").cast("int") + 1, F.col("first").cast("string"), F.col("last").cast("string"), F.col("s")).alias("line"))
    overall = returns.agg(F.count("*").alias("days"), F.count_distinct("split").alias("splits"), (F.avg("ret") * config.TRADING_DAYS * 100).alias("r"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(config.TRADING_DAYS))) * 100).alias("v"))
    heads = overall.select(F.posexplode(F.array(F.format_string("days %d, splits %d", "days", "splits"), F.format_string("annual return %.2f%%", "r"), F.format_string("annual volatility %.2f%%", "v"))).alias("n", "line"))
    return heads.select(F.col("n").cast("int").alias("n"), "line").unionByName(lines)


def envelope(rows: DataFrame, by: list[str], order: list[str], last: int, **fixed: str | int) -> DataFrame:
    """(by..., json): a response for each group: its fields, fixed ones, the number of rows and the last rows in their order."""
    newest = [F.desc(c) for c in order]
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("_n") <= last)  # at most `last` rows a group go on
    data = [c for c in rows.columns if c not in by]
    grouped = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in data if c not in order)))).alias("data"), F.count("*").alias("count"))
    return grouped.select(*by, F.to_json(F.struct(*by, *(F.lit(v).alias(k) for k, v in fixed.items()), "count", "data")).alias("json"))

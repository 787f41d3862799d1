"""Bars, quotes, orders and dimensions as DataFrames, from Parquet tables; sinks with first-writer-wins keys."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, a folder that goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A scan of df, written once: what is used in several places isn't planned and computed for each."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _traded(spark: SparkSession, sf_dir: str, name: str = "r_name") -> DataFrame:
    """Line items with part price and the supplier's region or nation."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    items = items.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return items.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def bars(spark: SparkSession, sf_dir: str, ticker: str = "r_name") -> DataFrame:
    """(date, ticker, open, high, low, close, volume), business days."""
    o = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    days = _traded(spark, sf_dir).where(F.dayofweek("l_shipdate").between(2, 6))
    return days.groupBy(F.to_date("l_shipdate").alias("date"), F.col(ticker).alias("ticker")).agg(F.min_by("p_retailprice", o).alias("open"), F.max("p_retailprice").alias("high"), F.min("p_retailprice").alias("low"), F.max_by("p_retailprice", o).alias("close"), (F.sum("l_quantity") * 1000).cast("long").alias("volume"))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, time, symbol, bid, ask)."""
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("symbol"), (F.col("value") - 0.5).alias("bid"), (F.col("value") + (F.col("event_id") % 5) * 0.25 - 0.25).alias("ask"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill for each line item."""
    return _traded(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("r_name").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("long").alias("quantity"), (F.col("p_retailprice") * (1 + (F.col("l_tax") - F.col("l_discount")) / 100)).alias("price"), F.col("p_retailprice").alias("expected_price"),
        ((F.col("l_tax") - F.col("l_discount")) * 100).alias("market_impact_bps"), (0.005 * F.col("l_quantity")).alias("commission"), F.to_date("l_shipdate").alias("date"), F.col("n_name").alias("portfolio"),
    )


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(config.SECTORS), "ticker string, sector string")


def business_days(span: DataFrame) -> DataFrame:
    """Every business day from the first to the last of one row (first, last)."""
    return span.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date")).where(F.dayofweek("date").between(2, 6))


def synthetic_bars(spark: SparkSession, tickers: list[str], first: str, last: str, seed: int = 42) -> DataFrame:
    """Geometric Brownian bars: drift + beta market + own noise, log-normal volume by weekday; numbers differ by design."""
    days = business_days(spark.createDataFrame([(first, last)], "a string, b string").select(F.to_date("a").alias("first"), F.to_date("b").alias("last")))
    market = days.withColumn("market", F.randn(seed) * 0.01)
    names = spark.createDataFrame([(t, 0.0003 + 0.00002 * i, 0.8 + 0.02 * i) for i, t in enumerate(tickers)], "ticker string, drift double, beta double")
    moves = market.join(F.broadcast(names)).withColumn("move", F.col("drift") + F.col("beta") * F.col("market") + F.randn(seed + 1) * 0.012)
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = moves.withColumn("close", F.round(100 * F.exp(F.sum("move").over(w)), 4))
    out = out.withColumn("open", F.round(F.col("close") * (1 + F.randn(seed + 2) * 0.003), 4))
    high, low = F.greatest("open", "close") * (1 + F.abs(F.randn(seed + 3)) * 0.004), F.least("open", "close") * (1 - F.abs(F.randn(seed + 4)) * 0.004)
    volume = F.exp(F.randn(seed + 5) * 0.3 + 15) * F.when(F.dayofweek("date").isin(2, 6), 1.1).otherwise(1.0)
    return out.select("date", "ticker", "open", F.round(high, 4).alias("high"), F.round(low, 4).alias("low"), "close", volume.cast("long").alias("volume"))


def synthetic_factors(spark: SparkSession, first: str, last: str, seed: int = 42) -> DataFrame:
    days = spark.createDataFrame([(first, last)], "a string, b string").select(F.explode(F.expr("sequence(to_date(a), to_date(b))")).alias("date"))
    return days.select("date", (F.randn(seed) * 0.01 + 0.0003).alias("mkt_rf"), (F.randn(seed + 1) * 0.005).alias("smb"), (F.randn(seed + 2) * 0.005).alias("hml"), F.lit(0.0001).alias("rf"))


#: Columns of a bar besides date and ticker.
OHLCV = ("open", "high", "low", "close", "volume")


def normalised(raw: DataFrame) -> DataFrame:
    """Downloaded bars: lower-case column names, open to volume alone beside date and ticker; the time of day and zone of the date dropped,
    rows without any price dropped, volume 0 where it is null."""
    low = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    kept = low.select(F.to_date(F.substring(F.col("date").cast("string"), 1, 10)).alias("date"), *(c for c in ("ticker", *OHLCV) if c in low.columns))
    prices = [c for c in OHLCV[:4] if c in kept.columns]
    kept = kept.na.drop(how="all", subset=prices) if prices else kept
    return kept.withColumn("volume", F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long"))) if "volume" in kept.columns else kept


def universe(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(bars of all tickers, (ticker, failed)): a CSV folder, or file, a ticker; tickers without a bar are failures, not errors. One scan.

    A row's ticker is that of exactly its file's folder (or its file)."""
    wanted = spark.createDataFrame([(t, _plain(_qualified(spark, p))) for t, p in paths.items()], "ticker string, path string")
    there = [p for p in paths.values() if _exists(spark, p)]
    if there:
        rows = spark.read.schema(schema).option("header", True).csv(there)
        # as a path: of a URI, where + is itself and %20 a space
        file = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
        file = F.regexp_replace(file, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
        rows = rows.withColumn("__file", file).withColumn("__folder", F.regexp_replace("__file", "/[^/]*$", ""))
        named = rows.withColumn("__place", F.explode(F.array("__folder", "__file"))).join(wanted.withColumnRenamed("path", "__place"), "__place")
    else:
        named = spark.createDataFrame([], schema).withColumn("ticker", F.lit(""))
    bars_ = normalised(named)
    found = bars_.groupBy("ticker").agg(F.count("*").alias("n"))
    return bars_, wanted.join(found, "ticker", "left").select("ticker", F.coalesce(F.col("n") == 0, F.lit(True)).alias("failed"))


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _plain(uri: str) -> str:
    """A qualified path with one slash after its scheme and none at its end."""
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.strip('/')}"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def upsert(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """What to append: rows whose key isn't there yet, once each (the smallest of equal keys)."""
    rest = [c for c in rows.columns if c not in key]
    new = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, *(F.col("r").getField(c).alias(c) for c in rest))
    return new.join(existing.select(*key), key, "left_anti")


def write_parquet(df: DataFrame, path: str, by: str | None = "ticker") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def cached(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """Read-through Parquet cache."""
    if force or not _exists(spark, path):
        write_parquet(make(), path, None)
    return spark.read.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows; nothing already there is rewritten or repeated."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)

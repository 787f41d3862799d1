"""Walk-forward classification with Spark ML: one model of all tickers a split, classes weighted by their counts, signals in a log of runs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..sources.market import written
from ..sources.store import Log
from . import indicators, signals

#: Rows of a split's training part at least.
LEAST_ROWS = 50
#: Splits that are fitted at the same time; each is a job of its own.
AT_ONCE = 4
#: Columns of the signal table.
SIGNALS = "date date, ticker string, split int, p_sell double, p_neutral double, p_buy double, signal_probability double, signal int"


def balanced(train: DataFrame, label: str = "label", counts: dict[float, int] | None = None) -> DataFrame:
    """train with `weight`: all rows over the number of classes times those of the row's class. counts: rows by class, if they are known."""
    if counts is None:
        counts = {r[0]: r.n for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    total = sum(counts.values())
    weight = F.coalesce(*(F.when(F.col(label) == c, F.lit(total / (len(counts) * n))) for c, n in counts.items())) if counts else F.lit(1.0)
    return train.withColumn("weight", weight)


def fitted(train: DataFrame, features: list[str], trees: int = 40, depth: int = 6, seed: int = 42) -> PipelineModel:
    """A forest on train (features, label as a class number from 0, weight); rows with a null or NaN feature are left out."""
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="0.8", maxBins=256, seed=seed)
    return Pipeline(stages=[assembled, forest]).fit(train)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return [(f, float(x)) for f, x in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p_sell, p_neutral and p_buy; a class that training didn't have has probability 0."""
    p = vector_to_array("probability")
    names = ("p_sell", "p_neutral", "p_buy")
    return model.transform(rows).select(*rows.columns, *(F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)))


def walk_forward(matrix: DataFrame, clean_bars: DataFrame, log: Log, purge: int = config.PURGE, features: list[str] = indicators.MATRIX, trees: int = 40, depth: int = 6) -> DataFrame:
    """Out-of-sample signals of every split, appended to the log as a run a split, and read back; (split, feature, importance) is a run beside each.

    A split that the log has already isn't fitted again. Splits are as many as the dates allow, whatever the number of tickers;
    each trains on all tickers' rows of its dates. signal_probability is the second class's, as the classes sort (-1, 0, 1)."""
    spark = matrix.sparkSession
    rows = written(matrix.join(signals.barrier_labels(clean_bars).select("date", "ticker", (F.col("label") + 1).cast("double").alias("label")), ["date", "ticker"]))
    dated = written(signals.in_splits(rows, signals.purged_splits(rows, purge)))
    done = {r.run for r in log.commits().select("run").collect()}

    counts: dict[int, dict[float, int]] = {}
    for r in dated.where("part = 'train'").groupBy("split", "label").agg(F.count("*").alias("n")).collect():  # a row a split and class
        counts.setdefault(r.split, {})[r.label] = r.n

    def fit(split: int) -> None:
        own = dated.where(F.col("split") == split)
        model = fitted(balanced(own.where("part = 'train'"), counts=counts[split]), features, trees, depth)
        p = F.col("p_neutral")
        out = predicted(model, own.where("part = 'test'").select("date", "ticker", "split", *features))
        named = spark.createDataFrame(importances(model, features), "feature string, importance double").coalesce(1).withColumn("split", F.lit(split))
        log.append(named, f"importance-{split}")
        log.append(out.select("date", "ticker", "split", "p_sell", "p_neutral", "p_buy", p.alias("signal_probability"), signals.bucket(p).cast("int").alias("signal")), f"split-{split}")

    splits = [k for k in sorted(counts) if sum(counts[k].values()) >= LEAST_ROWS and f"split-{k}" not in done]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(fit, splits))
    return signals_of(log)


def signal_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, SIGNALS + ", feature string, importance double")


def signals_of(log: Log) -> DataFrame:
    """The signal table."""
    return log.read().where("run LIKE 'split-%'").select(*(c.split()[0] for c in SIGNALS.split(", ")))


def importances_of(log: Log) -> DataFrame:
    return log.read().where("run LIKE 'importance-%'").select("split", "feature", "importance")

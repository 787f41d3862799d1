"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and rereads it as the next stage's docs. All stages but the last keep the columns of documents.

Nulls: a null text is scored as an empty one, is its own group, loses nothing, holds no benchmark words and encodes to no
ids. A null doc_id is never dropped as a near duplicate or as contaminated. Repeated rows of one doc_id are one document to
the near-duplicate stage, which keeps the one with the least text. Extra columns of any name and type pass through to the
last stage, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, quality, suffixes
from tidemark.llm.shared import materialise, table

#: Text bytes of a chunk in which repeats are removed; whole rows travel here, so chunks are smaller than the operator's own.
REPEAT_CHUNK = 6 << 20
#: Ids to drop that are broadcast at most (some 50 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among ids (a written table of distinct doc_ids)."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def unused(names: tuple[str, ...], docs: DataFrame) -> tuple[str, ...]:
    """Names that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return names


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(("quality_score",), docs)
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join: the one with the smallest doc_id."""
    groups = materialise(jaccard.linked(docs).where("doc_id is not null").select("doc_id", "component_id"))
    kept = without(docs, materialise(groups.where("component_id != doc_id").select("doc_id").distinct()))
    again = materialise(groups.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    rest = [c for c in docs.columns if c != "doc_id"]
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.coalesce("text", F.lit(""))).alias("row")).select("doc_id", *(F.col("row").getField(c).alias(c) for c in rest))
    return without(kept, again).select(docs.columns).unionByName(one.select(docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that also start earlier; those of which nothing is left go."""
    measures = unused(suffixes.MEASURES, docs)
    n_bytes, n_removed = measures[:2]
    out = suffixes.deduplicated(docs, chunk_bytes=REPEAT_CHUNK, measures=measures).where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_bytes)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    hit = decontaminate.hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return without(docs, materialise(hit.where("doc_id is not null").select("doc_id").distinct())).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids encoded and decoded again."""
    return bpe.round_trip(docs, bpe.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", to_tokens),
]

#: The classifier's training and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

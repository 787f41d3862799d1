"""Benchmark decontamination by a prefix-filtered set join; DataFrame and SQL operations only.

A benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one window). A window is the set of
its two-word shingles (of a single word where it has no more), and to contain the window whole a document must hold
all of them, so the necessary prefix in rarity order is its rarest shingle alone. Rarity is counted over all documents;
windows with a shingle that no document holds go at once. Documents' shingles meet the prefixes in a broadcast hash
join within the scan's own stage; the positional bound (the window must fit between the document's ends at the offset
of the shingle), the length bound, and last the words themselves are checked there, so only true hits leave it.

Prefixes are broadcast at most MAX_PREFIXES at a time (some 100 bytes each); more are taken in several passes.
Nulls: a null text has no words; items with a null id or without words match nothing. Repeated documents are each
reported; rows sharing a doc_id share their hits. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

WINDOW = 10
MAX_PREFIXES = 200_000
#: What separates words, for texts whose A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str = "text"):
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def _n_words(text: str = "text"):
    """Of an array that may begin and end with an empty word."""
    w = F.col(text)
    return F.coalesce(F.size(w) - (F.element_at(w, 1) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int"), F.lit(0))


def _shingled(rows: DataFrame, single: bool) -> DataFrame:
    """rows (words, ...) with each position at (from 1) and its shingle's hash."""
    each = rows.select("*", F.posexplode("words").alias("at0", "word")).withColumn("at", F.col("at0") + 1)
    if single:
        return each.withColumn("shingle", F.xxhash64("word"))
    return each.where("at < size(words)").withColumn("shingle", F.xxhash64("word", F.expr("words[at]")))


def windows(items: DataFrame) -> DataFrame:
    """(item_id, window array) of all items (item_id, text)."""
    whole = items.where("item_id is not null and text is not null").select("item_id", F.filter(_words(), lambda w: w != "").alias("words")).where("size(words) > 0")
    return whole.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(words) - {WINDOW - 1}, 1)), i -> slice(words, i, {WINDOW}))")).alias("window")).distinct()


def hits(docs: DataFrame, items: DataFrame, max_prefixes: int = MAX_PREFIXES) -> DataFrame:
    """(doc_id, item_id, first, last): every occurrence of a window, as positions of words from 1 on."""
    every = materialise(windows(items).withColumn("key", F.xxhash64("window")))
    n = every.agg(F.count("*").alias("n"), F.count_if(F.size("window") == 1).alias("single")).first()
    words = docs.where("text is not null").select("doc_id", _words().alias("words"))
    out = None
    for single in [False] * (n.n > n.single) + [True] * (n.single > 0):
        parts = -(-n.n // max_prefixes)
        own = every.where(F.size("window") == 1 if single else F.size("window") > 1)
        for part in range(parts):
            mine = own.where(F.pmod("key", F.lit(parts)) == part).withColumn("words", F.col("window"))
            shingles = _shingled(mine, single).select("item_id", "window", "shingle", "at")
            held = _shingled(words, single).join(F.broadcast(shingles.select("shingle").distinct()), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("n"))
            ranked = shingles.join(held, "shingle", "left").groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("rarest")).where("rarest.n > 0")
            prefixes = ranked.select("item_id", "window", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("offset"))
            at = F.col("at") - F.col("offset") + 1
            fits = (at >= 1) & (at + F.size("window") - 1 <= F.size("words"))
            found = _shingled(words, single).join(F.broadcast(prefixes), "shingle").where(fits & (F.slice("words", F.when(fits, at).otherwise(1), F.size("window")) == F.col("window")))
            found = found.select("doc_id", "item_id", at.alias("first"), (at + F.size("window") - 1).alias("last"))
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first int, last int")


def report(docs: DataFrame, items: DataFrame, max_prefixes: int = MAX_PREFIXES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for each row of docs; items: sorted ids as strings."""
    union = "aggregate(spans, struct(0 as n, 0 as last), (a, s) -> struct(a.n + greatest(0, s.last - greatest(s.first - 1, a.last)) as n, greatest(a.last, s.last) as last)).n"
    found = hits(docs, items, max_prefixes).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = found.select("doc_id", F.expr(union).alias("n_hit"), "items")
    counted = docs.select("doc_id", _words().alias("words")).select("doc_id", _n_words("words").cast("long").alias("n_words"))
    out = counted.join(found, "doc_id", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(words[i : i + 9], ' ') AS win FROM (SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(words[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM w, ks WHERE len(words) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""

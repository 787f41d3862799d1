"""Filter interaction audit: what each of k filters removes at each place of every order, from one pass over the documents.

1.  Masks: a document's failed filters are the bits of a number. Of each part only the counts of its 2**k masks go on.
2.  Subset-zeta transform: k rounds of adding neighbours turn the counts of masks into z[T], the documents whose failures all
    lie within T. The survivors of a set S of filters are z[all but S].
3.  Steps: what a filter removes after a set P is the difference of two neighbouring subsets, survivors(P) - survivors(P + filter);
    the same for documents with a label. Shapley sums weigh these differences by the orders in which P comes first.

A copy (filter E) is told by the sha256 of its text: of each digest the smallest doc_id is found by partial aggregation and joined
back on doc_id and digest, so that a text with any number of copies is no hot key.

Nulls: a null text is an empty one, so all null and empty texts are copies of each other. A null lang belongs to the part of the
empty string. A row without doc_id is a copy of nothing and has no label; the others are still judged without it. Rows that share doc_id and text don't make each other
copies and count once each. A document of which several labels are given is good (toxic) if one of them says so.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

#: The filters' letters; bit i of a mask stands for the i-th.
FILTERS = "ABCDE"
#: White space between words.
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("rows", "good", "toxic")


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each row of docs (doc_id, text, lang): bits of the filters that a text fails by itself."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", CAPITALS, ""))
    failed = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def with_copies(facts: DataFrame, bit: int) -> DataFrame:
    """(doc_id, part, mask, n) of facts (doc_id, part, digest, mask): bit is set in the mask of copies of a text of a smaller doc_id; n counts repeated rows."""
    firsts = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = facts.where("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    told = rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(bit)).alias("mask"), "n")
    nameless = facts.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    return told.unionByName(nameless.withColumn("doc_id", F.lit(None).cast(facts.schema["doc_id"].dataType)))


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic) of masked (doc_id, part, mask, n) and labels (doc_id, quality, toxic)."""
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    named = masked.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    every = named.unionByName(masked.where("doc_id is null").select("part", "mask", "n"), allowMissingColumns=True)
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("rows"), of("good"), of("toxic"))


def zeta(counts: DataFrame, k: int, names: tuple[str, ...] = COUNTS) -> DataFrame:
    """(part, an array for each name, shifted copies of counts under `of_` and the name): at place T the sum over all masks within T."""
    full = (1 << k) - 1
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names))))
    out = counts.groupBy("part").agg(entries.alias("by_mask"))
    places = F.sequence(F.lit(0), F.lit(full))
    array = lambda c: F.transform(places, lambda i: F.coalesce(F.try_element_at("by_mask", i)[c], F.lit(0).cast("long")))
    out = out.select("part", *(array(c).alias(f"of_{c}") for c in names)).select("*", *(F.col(f"of_{c}").alias(c) for c in names))
    for b in range(k):
        step = lambda c, b=b: F.transform(c, lambda x, i: x + F.when(i.bitwiseAND(1 << b) != 0, F.get(c, i - (1 << b))).otherwise(0))
        out = out.select("part", *(f"of_{c}" for c in names), *(step(F.col(c)).alias(c) for c in names))
    return out


def shapley(survivors: Column, k: int, bit: int) -> Column:
    """Removals of the filter with that bit, summed over all orders; survivors: the zeta array."""
    full = (1 << k) - 1
    others = [p for p in range(1 << k) if not p & bit]
    return sum((F.lit(factorial(p.bit_count()) * factorial(k - 1 - p.bit_count())) * (survivors[full ^ p] - survivors[full ^ p ^ bit]) for p in others), F.lit(0).cast("long"))


def orders(parts: DataFrame, filters: str) -> DataFrame:
    """parts with a row for each order of the filters (filter_order) and place in it (step, from 1), its filter's bit and the bits of those before it."""
    letters = F.array(*(F.lit(c) for c in filters))
    out = parts.withColumn("filter_order", F.lit(""))
    for _ in filters:
        out = out.withColumn("letter", F.explode(letters)).where(~F.col("filter_order").contains(F.col("letter"))).withColumn("filter_order", F.concat("filter_order", "letter"))
    bit = lambda at: f"shiftleft(1, instr('{filters}', substr(filter_order, {at}, 1)) - 1)"
    out = out.drop("letter").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    return out.withColumn("bit", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, {len(filters)}), 0, (a, i) -> if(i < step, a | {bit('i')}, a))"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from counts (part, mask, rows, good, toxic); filters: a letter a bit, at most eight."""
    k = len(filters)
    if k > 8:
        raise ValueError("more than eight filters have too many orders")
    full = (1 << k) - 1
    z = zeta(counts, k)
    z = z.withColumn("shares", F.array(*(shapley(F.col("rows"), k, 1 << i) for i in range(k))))
    after = lambda c, s: F.get(F.col(c), F.lit(full).bitwiseXOR(s))  # noqa: E731  survivors of a set of filters
    before, bit = F.col("before"), F.col("bit")
    removed = lambda c: after(c, before) - after(c, before.bitwiseOR(bit))
    fails = after("rows", F.lit(0)) - after("rows", bit)
    return orders(z, filters).select(
        "part", "filter_order", "step", after("rows", before.bitwiseOR(bit)).alias("kept"), removed("rows").alias("removed"), (fails - removed("rows")).alias("redundant"),
        F.get(F.col("of_rows"), bit).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"),
        F.get(F.col("shares"), F.expr(f"instr('{filters}', substr(filter_order, step, 1)) - 1")).alias("shapley"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialise(text_failures(table(spark, sf_dir, "documents")))
    return audit(mask_counts(with_copies(facts, 1 << FILTERS.index("E")), table(spark, sf_dir, "labels")))


#: Without the transform: each step summed over the masks of its part.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
words AS (SELECT t.doc_id, t.part, t.text, f.first_id, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS w FROM texts t JOIN firsts f ON t.text = f.text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(words.doc_id > first_id, false) AS e
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
),
masks AS (
  SELECT part, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END + CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY 1, 2
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
perms AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
    AND length(replace(replace(replace(replace(replace('ABCDE', p.letter, ''), q.letter, ''), r.letter, ''), s.letter, ''), t.letter, '')) = 0
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier FROM perms, (SELECT unnest([1, 2, 3, 4, 5]) AS step) g
),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (earlier | bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & earlier) = 0 AND (mask & bit) != 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & earlier) != 0 AND (mask & bit) != 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & earlier) = 0 AND (mask & bit) != 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & earlier) = 0 AND (mask & bit) != 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

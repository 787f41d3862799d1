"""URL filters that follow redirects: block decisions reach every alias of a blocked url.

Rules name a host and a path, and fit that host and its subdomains below that path; the longest that fits decides a
page. Pages without a rule of their own follow their equivalence class: redirects (meta refresh) and canonical links
found in the pages' html join urls into connected components, in which an explicit allow comes before any block, and
a block decides the other members. Pages that no class decides are allowed.

Nodes of the graph are urls without scheme and fragment, numbered in a written table; only urls with links enter it.
Nulls: a null url, and one without `://`, has empty host and path and no rule; a null html has no links. Repeated pages
are each judged. Relative targets are resolved against the page's url, or its base element, and `&amp;` in them is read
as `&`; urls that are written in full, pages' own and targets', keep their path as it is. Targets of another kind of
scheme (`mailto:x`) lead to no page.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, materialise, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""

BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def _host(url: Column) -> Column:
    return F.coalesce(_lowered(F.regexp_extract(url, URL, 1)), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _node(url: Column) -> Column:
    return F.concat(_host(url), _path(url), F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule and own (the rule's verdict)."""
    out = pages.withColumns({"host": _host(F.col("url")), "path": _path(F.col("url"))})
    rule, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, own = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(own)
    return out.withColumns({"rule": rule, "own": own})


def _without_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.array_append(done, x))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), end), "/"))


def _resolved(to: Column, base: Column) -> Column:
    """The url that a link leads to from base, with any scheme; null if it isn't one of a page."""
    to = F.regexp_replace(to, "(?i)&(amp|#38|#x26);", "&")
    path, rest = F.regexp_extract(to, "^[^?#]*", 0), F.regexp_extract(to, "(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(_path(base), "(?s)^.*/", 0)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    here = F.when(rest.startswith("?"), F.concat(F.lit("x://"), _host(base), _path(base), rest)).otherwise(F.concat(F.lit("x://"), _node(base)))
    out = F.when(to.rlike(f"{SCHEME}//"), to).when(to.rlike(SCHEME), F.lit(None)).when(to.startswith("//"), F.concat(F.lit("x:"), to))
    return out.when(path == "", here).otherwise(F.concat(F.lit("x://"), _host(base), _without_dots(whole), rest))


def links(pages: DataFrame) -> DataFrame:
    """(source, target) nodes that a page's canonical link and redirect join."""
    linked = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").contains("://"))
    found = linked.select("url", F.regexp_extract("html", BASE, 1).alias("base"), F.explode(F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))).alias("to"))
    found = found.withColumn("base", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(_resolved(F.col("base"), F.col("url")), F.col("url"))))
    return found.select(_node(F.col("url")).alias("source"), _node(_resolved(F.col("to"), F.col("base"))).alias("target")).where("target is not null and target != '' and source != target").distinct()


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html)."""
    found = materialise(links(pages.select("url", "html")))
    own = judged(pages.select("page_id", "url"), rules)
    if found.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    nodes = found.select(F.col("source").alias("key")).unionByName(found.select(F.col("target").alias("key"))).distinct()
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()))
    ids = found.join(nodes.select(F.col("key").alias("source"), F.col("id").alias("u")), "source").join(nodes.select(F.col("key").alias("target"), F.col("id").alias("v")), "target").select("u", "v")
    classes = materialise(nodes.join(components(ids), F.col("id") == F.col("node")).select("key", "component"))
    # a link's end decides as a page would, whether or not it was crawled
    known = judged(classes.withColumn("url", F.concat(F.lit("x://"), "key")), rules)
    decided = known.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    by_class = classes.join(decided, "component").where("blocked and not coalesce(allowed, false)").select("key")
    # pages with a rule of their own don't meet the classes
    settled = own.where("own is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict"))
    asked = own.where("own is null").withColumn("key", _node(F.col("url"))).join(by_class.withColumn("by_class", F.lit(True)), "key", "left")
    return settled.unionByName(asked.select("page_id", "host", "path", "rule", F.coalesce(F.when(F.col("by_class"), "block"), F.lit("allow")).alias("verdict")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))


_RULE = """CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule"""
SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS html, position('://' IN coalesce(url, '')) AS pos, coalesce(url, '') AS url FROM pages),
q AS (SELECT page_id, html, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM p),
r AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM q),
ruled AS (SELECT *, RULE FROM r),
tags AS (SELECT host || path || query AS source, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM r WHERE host || path <> ''),
hrefs AS (SELECT source, CASE WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
 WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS href FROM tags),
ends AS (SELECT source, regexp_replace(regexp_replace(href, '#.*$', ''), '^[^:]*://', '') AS t FROM hrefs WHERE href LIKE '%://%'),
e AS (SELECT DISTINCT source, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(t, '^[^/?#]*', '') AS target FROM ends),
pairs AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
known AS (SELECT DISTINCT host || path || query AS key, rule FROM ruled WHERE rule IS NOT NULL
 UNION SELECT key, RULE FROM (SELECT target AS key, regexp_extract(target, '^[^/?]*') AS host, regexp_extract(regexp_replace(target, '^[^/?]*', ''), '^[^?]*') AS path FROM e)),
side AS (SELECT a, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS allowed, bool_or(rule IN ('net/', 'example.com/de/')) AS blocked FROM reach JOIN known ON b = key GROUP BY 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN side ON a = host || path || query
""".replace("RULE", _RULE)

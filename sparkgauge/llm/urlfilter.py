"""URL filters: every URL is expanded into host-suffix and path-prefix expressions, which an equi-join on short hash
prefixes holds against a table of rules; full digests confirm, and the longest rule wins.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's. Only the
shapes that the rules have (number of host labels, length of path) are expanded, so a URL makes at most one expression
per shape, however long it is, and any rule path is met exactly, at segment borders or not.

All is native. Equal URLs are judged once, so hot ones collapse before the shuffle; the rules are broadcast if their
count is small, else Spark shuffles both sides.

Defined cases: null URLs and those without ``://`` have empty host and path, and no rule; of two rules of equal length
(equal ones, then) ``block`` wins; without a rule the verdict is ``default``; columns of the input other than the URL
aren't touched.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, spread, table, whole, written

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PREFIX_HEX = 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def hashed(expression: Column) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [digest.alias("digest"), F.conv(F.substring(digest, 1, PREFIX_HEX), 16, 10).cast("long").alias("short")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table: host, path, verdict, rule (their expression), digest, short."""
    df = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    df = df.withColumn("rule", F.concat("host", "path"))
    return df.select("host", "path", "verdict", "rule", *hashed(F.col("rule")))


def judged_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(u, rule, verdict) for those of ``urls`` (u, distinct) that a rule fits."""
    shape = F.struct(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    shapes = [r[0] for r in rules.select(shape.alias("s")).distinct().orderBy("s").collect()]  # bounded by the rules' shapes
    parts = urls.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).where(F.col("host") != "")
    parts = parts.withColumn("labels", F.split("host", r"\."))
    if not shapes:
        return parts.limit(0).select("u", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    data = F.from_json(F.lit(json.dumps([s.asDict() for s in shapes])), "array<struct<labels:int,chars:int>>")  # folded to one literal
    fitting = F.filter(data, lambda s: (F.size("labels") >= s["labels"]) & (F.length("path") >= s["chars"]))
    made = F.transform(fitting, lambda s: F.concat(F.array_join(F.slice("labels", -s["labels"], s["labels"]), "."), F.substring("path", F.lit(1), s["chars"])))
    rows = parts.select("u", F.explode(made).alias("e"))
    rows = rows.select("u", *hashed(F.col("e")))
    # the join is on the short hash alone; the full digest is confirmed on what it lets through, as no part of the key
    confirmed = F.array_contains(F.array(F.col("r.digest")), rows["digest"])
    hits = rows.join(small(rules).alias("r"), (rows["short"] == F.col("r.short")) & confirmed)
    best = F.max(F.struct(F.length("r.rule").alias("n"), (F.col("r.verdict") == "block").alias("block"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")))
    return hits.groupBy("u").agg(best.alias("best")).select("u", "best.rule", "best.verdict")


def filtered(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` in a struct ``d`` with host, path, rule and verdict."""
    rows = pages.select(whole(pages).alias("d")).withColumn("u", F.coalesce(F.col("d")[url], F.lit("")))
    found = judged_urls(rows.select("u").distinct(), rules)
    out = spread(rows, found, "u", F.xxhash64("d"), "left")  # hot URLs, null ones among them, are dealt over tasks
    return out.select("d", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5(spark, sf_dir: str) -> DataFrame:
    rules = written(rule_table(spark))
    out = filtered(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("d.page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(COALESCE(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    COALESCE(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS n
  FROM (SELECT DISTINCT page_id, host, path FROM parts) x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT a.page_id, a.host, a.path, b.rule, COALESCE(b.v, 'allow') AS verdict
FROM parts a LEFT JOIN hits b ON a.page_id IS NOT DISTINCT FROM b.page_id AND a.host = b.host AND a.path = b.path AND b.n = 1
"""

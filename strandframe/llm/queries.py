"""The queries of this folder's operators over the driver tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontam, dedup, lm, packing, pii, quality, secrets, sharding, toxicity, urls
from strandframe.llm.text import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.held_out(F.col("doc_id"))
    out = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    return out.withColumn("held_out", held)


def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_rules(read(spark, sf_dir, "documents"))


def op6_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.longest_first(read(spark, sf_dir, "documents"))


def op7_bootstrap_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_identifiers(read(spark, sf_dir, "documents"))


def op8_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lm.held_out(F.col("doc_id"))
    return lm.score_texts(read(spark, sf_dir, "documents"), ~held).withColumn("held_out", F.coalesce(held, F.lit(False)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_template_leaks": op2_template_leaks,
    "op3_minhash": op3_minhash,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_compression_rules": op5_compression_rules,
    "op6_longest_first": op6_longest_first,
    "op7_bootstrap_pii": op7_bootstrap_pii,
    "op8_novelty_secrets": op8_novelty_secrets,
    "op9_context_mixing": op9_context_mixing,
    "op10_url_filter": op10_url_filter,
}

_RULES = ", ".join(f"('{kind}', '{host}', '{path}')" for kind, host, path in urls.RULES)
_NODE = "translate(regexp_extract(regexp_extract({0}, '^.*?://([^?#]*)', 1), '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(regexp_extract({0}, '^.*?://([^?#]*)', 1), '^[^/]*(.*)$', 1)"
_OWN = "(SELECT arg_max(struct_pack(t := host || path, k := kind), length(host || path)) FROM rules WHERE ({0} = host OR ends_with({0}, '.' || host)) AND starts_with({1}, path))"

_SHINGLES = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s)"""

#: SQL where it can say the same. Links with absolute or root-relative targets; the other queries are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op3_minhash": f"""WITH RECURSIVE {_SHINGLES},
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common, any_value(a.n) AS m, any_value(b.n) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM pairs WHERE 100 * common >= 85 * (m + n - common)), e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, e2.v FROM reach r JOIN e2 ON r.other = e2.u),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = node""",
    "op10_url_filter": f"""WITH RECURSIVE rules(kind, host, path) AS (VALUES {_RULES}),
p AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS at_host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS at_path FROM p),
j AS (SELECT page_id, at_host, at_path, {_OWN.format("at_host", "at_path")} AS own FROM h),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM h WHERE contains(url, '://')),
targets AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link.*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) WHEN regexp_matches(tag, '(?is)^<meta.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END AS target FROM tags),
full_targets AS (SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || target END AS target FROM targets),
links AS (SELECT DISTINCT {_NODE.format("url")} AS u, {_NODE.format("target")} AS v FROM full_targets WHERE target IS NOT NULL AND target <> ''),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
members AS (SELECT node, other, regexp_extract(other, '^([^/]*)', 1) AS m_host, regexp_extract(other, '^[^/]*(.*)$', 1) AS m_path FROM reach),
shared AS (SELECT node, CASE WHEN bool_or(own.k = 'allow') THEN 'allow' WHEN bool_or(own.k = 'block') THEN 'block' END AS verdict FROM (SELECT node, {_OWN.format("m_host", "m_path")} AS own FROM members) GROUP BY 1)
SELECT page_id, at_host AS host, at_path AS path, own.t AS rule, coalesce(own.k, verdict, 'allow') AS verdict FROM j LEFT JOIN shared ON node = at_host || at_path""",
}

"""Queries over the training-data operators, with their parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, langid, mixing, simhash, substring_dedup, token_counts, toxicity, url_filter
from .common import fold, table, written

#: Public tokenizers; executors have them in the same place.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The pattern that goes with BYTE_BPE.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_REPEATS = 2.0
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    index = toxicity.fit(toxicity.learning_rows(docs), toxicity.learning_rows(labels))
    found = toxicity.score(docs, index)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "terms")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("n_tokens"))
    return mixing.mix(written(docs, "mix-tokens"), F.col("n_tokens"), max_repeats=MAX_REPEATS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.learning_rows(docs))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected", "nats")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = found.select(F.when(F.col("id") != substring_dedup.LAST, F.col("id")).alias("doc_id"), F.explode("spans").alias("x"))
    return spans.select("doc_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, digests=True)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "links")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_PATTERN)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), RULES, url_filter.labelled_urls(spark))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, without the model."""
    host, path = url_filter.host_and_path(F.col("url").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule = url_filter.longest_rule(F.col("host"), F.col("path"), RULES)
    return rows.withColumn("r", rule).select("page_id", "host", "path", F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict"))


def mixing_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, documents and quota of every source."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").cast("string").alias("source"))
    totals = docs.agg(F.sum(mixing.words(F.col("text"))).alias("tokens"), F.count("*").alias("docs"))
    return mixing.source_weights(totals, max_repeats=MAX_REPEATS).select("source", "tokens", "docs", "quota", "met")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_bpe": op6_bpe,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_filter": op10_url_filter,
    "url_rules": url_rules,
    "mixing_quotas": mixing_quotas,
}
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: What of the operators SQL can tell. Models, hashes and tokenizers it can't: tests/llm compares those with brute-force versions.
ORACLES: dict[str, str] = {
    "url_rules": f"""WITH x AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
y AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM x),
r(h, p, v) AS (VALUES {_RULES}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS verdict FROM y JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT y.page_id, host, path, rule, verdict FROM y LEFT JOIN fit USING (page_id)""",
    "mixing_quotas": f"""WITH RECURSIVE t AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+'))) AS BIGINT) AS tokens, count(*) AS docs FROM documents GROUP BY source),
s AS (SELECT list(CAST(tokens AS DOUBLE) / total) FILTER (WHERE tokens > 0) AS ps, any_value(total) AS total FROM t, (SELECT sum(tokens) AS total FROM t)),
b(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
 SELECT i + 1, CASE WHEN high THEN (lo + hi) / 2 ELSE lo END, CASE WHEN high THEN hi ELSE (lo + hi) / 2 END FROM (SELECT i, lo, hi, list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_min(list_transform(ps, lambda x: pow(x, (lo + hi) / 2 - 1))) > {MAX_REPEATS} AS high FROM b, s WHERE i < {mixing.STEPS})),
e AS (SELECT CASE WHEN list_max(list_transform(ps, lambda x: pow(x, -1))) / list_min(list_transform(ps, lambda x: pow(x, -1))) > {MAX_REPEATS} THEN (SELECT hi FROM b ORDER BY i DESC LIMIT 1) ELSE 0 END AS a, ps, total FROM s),
z AS (SELECT a, ps, total, list_sum(list_transform(ps, lambda x: pow(x, a))) AS z FROM e),
q AS (SELECT a, total, z, list_max(list_transform(ps, lambda x: x / (pow(x, a) / z))) * total AS scale FROM z)
SELECT source, tokens, docs, CASE WHEN tokens = 0 THEN 0 ELSE least(CAST(round(pow(CAST(tokens AS DOUBLE) / total, a) / z * scale) AS BIGINT), CAST(round(tokens * {MAX_REPEATS}) AS BIGINT)) END AS quota, true AS met FROM t, q""",
}

"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import embedding_dedup, line_dedup, mixing, packing, phrase_dedup, prefix_trie, quality, shingle_join, spelling, suffix_dedup, token_count, toxicity, url_filter
from voxmill.session import stored_once

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The same rules in plain SQL: all that fit, the longest first.
URL_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
"""
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = line_dedup.drop_similar_lines(table(spark, sf, "documents"))
    return left.select("doc_id", "n_lines", "n_lines_gone", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_dedup.drop_repeated_bytes(table(spark, sf, "documents"))
    gone, runs = suffix_dedup.removed()
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), runs.alias("n_spans"), "kept_sha256")


def op4_shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    found = shingle_join.join_shingles(table(spark, sf, "documents"), width=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"))


def op7_phrase_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = phrase_dedup.drop_repeated_phrases(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", suffix_dedup.removed()[0].alias("n_removed"), "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_count(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf, "documents"), public_tokenizers.path(PIECES))
    return counted.select("doc_id", "n_words", "n_tokens", "n_unknown")


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE))
    return packed.select("doc_id", "start", "length", packing.piece_digest().alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.learn(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = stored_once(prefix_trie.ordered_turns(table(spark, sf, "conversations")), "turns")
    conv_ids = turns.filter("place = 0").select("conv_id")
    return prefix_trie.prefix_trie(stored_once(prefix_trie.spliced(turns), "spliced"), conv_ids)


def op13_spelling_groups(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf, "documents"), drop_every=31)


def all_queries() -> dict[str, Query]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def all_sql() -> dict[str, str]:
    return {"op5_url_filter": URL_SQL}

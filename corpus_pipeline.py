"""From raw documents to packed training sequences, in stages.

Every stage takes the documents that the one before it left and works on all of them. What
a stage returns is written to the shared folder, read again by the next one and then deleted.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import line_dedup, mixing, packing, quality, shingle_join
from voxmill.llm.common import GAPS, semi_join, text_key
from voxmill.session import drop_stored, stored_once

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go. Null and empty texts
    have too few words and go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.quality_rules(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go; a document of which no word is left
    goes, and ``n_chars`` is counted anew."""
    left = line_dedup.drop_similar_lines(docs)
    left = left.filter((F.col("n_lines_gone") == 0) | (F.btrim("text", F.lit(GAPS)) != ""))
    n_chars = F.when(F.col("n_lines_gone") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*(n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def shingle_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links reach, the one with the smallest id stays. Of
    rows that repeat an id and a text one stays; documents without words stay."""
    found = shingle_join.join_shingles(docs)
    stays = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id", "tkey")
    left = semi_join(docs, stays.distinct())
    again = [F.col("doc_id").alias("_llm_id"), text_key(F.col("text")).alias("_llm_key")]
    left = left.select(F.struct(*left.columns).alias("row"), *again).dropDuplicates(["_llm_id", "_llm_key"])
    return left.select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to equal weights, documents in a random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("tkey")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("shingle join", shingle_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Links between documents and the packing can't be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stored(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

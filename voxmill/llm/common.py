"""Shared pieces: words, row keys, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.session import drop_stored, stored_once

#: ASCII white space; a word is a run of anything else.
GAPS = " \t\n\x0b\x0c\r"
GAP_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text in their order; none for a null or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_RUN))


def spaced(text: Column) -> Column:
    """The words of a text joined by one space each, without making them."""
    plain = F.coalesce(text, F.lit(""))
    for gap in GAPS.replace(" ", ""):
        plain = F.replace(plain, F.lit(gap), F.lit(" "))
    plain = F.trim(plain)
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """With the id it tells rows apart: rows of one id and one text are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """id, text and the key of each row, and nothing else but ``more``."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("tkey"), *more
    )


def in_struct(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``rows`` in a struct ``row``, where no name can clash with ours."""
    return rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))


def of_row(name: str) -> Column:
    return F.col(f"row.`{name}`")


def semi_join(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``keys`` (doc_id, tkey) names."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"))
    same = of_row(id_col).eqNullSafe(F.col("_id")) & (text_key(of_row(text_col)) == F.col("_key"))
    return in_struct(docs, docs.columns).join(keys, same, "left_semi").select("row.*")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``edges`` (a, b): the smallest id that links reach.

    Large-star and small-star steps in turn until no edge changes. Each step is one
    minimum per node, combined before the shuffle, and one join; its result is written to
    the shared folder, so lineage stays short and a lost executor costs one step. Only the
    last step's stays there.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored_once(edges, "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        before, edges = edges, stored_once(_small_star(_large_star(edges)), "edges")
        drop_stored(before)
    roots = edges.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    return roots.union(edges.select("b", "b").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    low = low.select("node", F.least("node", "low").alias("low"))
    return both.filter("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    moved = edges.join(low, F.col("a") == F.col("node"))
    return moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()

"""Choosing threads: filters, ranked candidate lists, merging, top-k."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions.scalars import cutoff

# Parts that every group is cut down in before its rows meet.
GROUP_PARTS = 64


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


# -- filters (FLT1-4, FLT7) -------------------------------------------------


def open_only(df: DataFrame, state: str = "state", value: str = "open") -> DataFrame:
    return df.where(F.col(state) == value)


def without_pull_requests(df: DataFrame, pull_request: str = "pull_request") -> DataFrame:
    return df.where(F.col(pull_request).isNull())


def recent(
    df: DataFrame, moment: str | Column, as_of: dt.datetime | Column, days: int = vocab.RECENT_DAYS
) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; the edge itself is kept.

    Choose the column per source: last update for issues, creation for posts and topics.
    """
    return df.where(_column(moment) >= cutoff(as_of, days))


def in_categories(
    df: DataFrame, category: str = "category_id", ids: Sequence[int] = vocab.TOPIC_CATEGORY_IDS
) -> DataFrame:
    return df.where(F.col(category).isin(list(ids)))


def of_source(df: DataFrame, source: str | None = None, column: str = "source") -> DataFrame:
    """One source, or all where none is named. Prunes partitions of the thread table."""
    return df if source is None else df.where(F.col(column) == source)


# -- ranked lists (TOP1-4) --------------------------------------------------


def top(df: DataFrame, score: str | Column, k: int, *ties: str | Column) -> DataFrame:
    """The ``k`` highest rows, ties in the order of ``ties``.

    Every task keeps only its own best ``k``, so nothing but ``k`` rows per task moves.
    """
    return df.orderBy(_column(score).desc(), *(_column(t).asc() for t in ties)).limit(k)


def ranked(df: DataFrame, score: str | Column, k: int, *ties: str | Column) -> DataFrame:
    """As ``top``, with the place in the list. The window sees ``k`` rows."""
    order = Window.orderBy(_column(score).desc(), *(_column(t).asc() for t in ties))
    return top(df, score, k, *ties).withColumn("place", F.row_number().over(order))


# -- merging (SET1, SET2) ---------------------------------------------------


def merge_candidates(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Join ranked lists end to end and keep each key once.

    A key keeps its first position and its last value. The input are ranked lists, so
    the grouping is over a few hundred rows.
    """
    numbered = [one.withColumn("list_no", F.lit(n)) for n, one in enumerate(lists)]
    joined = concatenate(numbered)
    at = F.struct("list_no", "place")
    values = [c for c in lists[0].columns if c not in (key, "place")]
    merged = joined.groupBy(key).agg(
        F.min(at).alias("first_place"), F.max_by(F.struct(*values), at).alias("value")
    )
    return merged.select(key, "value.*", "first_place")


def keep_last_value(df: DataFrame, key: str | Column, position: str) -> DataFrame:
    """The same rule for a whole table: first position kept, last value wins.

    The grouping moves two numbers per key and task, so a key with a third of all rows
    costs no more than another; the rows themselves are fetched by their unique
    position. Long keys are grouped by their digest.
    """
    spans = (
        df.groupBy(F.sha2(_column(key), 256).alias("digest"))
        .agg(F.min(position).alias("first_position"), F.max(position).alias("last_position"))
        .select("first_position", F.col("last_position").alias(position))
    )
    return df.join(spans, position)


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames end to end by column name; a column one of them lacks is NULL there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


# -- per group (TOP5) -------------------------------------------------------


def top_per_group(
    df: DataFrame, group: str, score: str | Column, k: int, *ties: str | Column
) -> DataFrame:
    """The ``k`` highest rows of every group, with their place.

    One plan for every ``k``: each group is dealt to parts by a digest of its rows, each part
    is cut down to its own best ``k``, and only these meet. So a hot group is never sorted in
    one task, also where ``k`` is above the number up to which Spark cuts groups before the
    shuffle by itself. Rows that tie in everything else are told apart by the digest, so
    the same rows win each time. Rank narrow rows; no column may be a map.
    """
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    ordering = [_column(score).desc(), *(_column(t).asc() for t in ties), F.col("_digest").asc()]

    def limited(frame: DataFrame, *within: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*ordering))
        return frame.withColumn("place", place).where(F.col("place") <= k)

    dealt = df.withColumn("_digest", digest).withColumn("_part", F.pmod("_digest", F.lit(GROUP_PARTS)))
    return limited(limited(dealt, group, "_part").drop("place"), group).drop("_digest", "_part")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of every key; copies are cut down before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*(_column(o).asc() for o in order))
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def fetch(wide: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """Full rows of the winners. Rank on narrow columns first, then come here once; Spark
    picks the join by the size of the winners."""
    return wide.join(winners, key)

"""Counting categorised items.

All reports need one item attribute at a time, so the items are read and shuffled once,
into counts by kind, category and the value of each attribute. That table grows with the
number of different values, not with the items and not with the combinations of values,
and every table below is rolled up from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill import vocab

DIMENSIONS = ("sentiment", "priority", "source", "user_type", "confidence")


def item_counts(
    items: DataFrame, dimensions: Sequence[str] = DIMENSIONS, position: str | None = None
) -> DataFrame:
    """Items counted by kind, category and attribute value, one attribute per row.

    Counts are combined before the shuffle, so a category with a third of all items is
    no heavier than another. ``position`` (a number) also keeps the first place at which
    a combination was seen, for breaking ties. ``priority`` has to be among the
    attributes: it stands for the item where attributes do not matter.
    """
    kept = ["kind", "category"] + ([position] if position is not None else [])
    measures = [F.count(F.lit(1)).alias("n")]
    if position is not None:
        measures.append(F.min(position).alias("first_pos"))
    if len(dimensions) == 1:
        (only,) = dimensions
        long = items.select(*kept, F.lit(only).alias("dim"), F.col(only).alias("value"))
    else:
        long = items.unpivot(kept, list(dimensions), "dim", "value")
    return long.groupBy("kind", "dim", "category", "value").agg(*measures)


def of_dimension(counts: DataFrame, dimension: str = "priority") -> DataFrame:
    """The rows of one attribute. Every item is counted in exactly one of them."""
    return counts.where(F.col("dim") == dimension)


# -- tables from the counts (AGG1-5, SET3) ----------------------------------


def crosstab(counts: DataFrame) -> DataFrame:
    """Category by attribute value, all attributes in one long table."""
    return counts.select("kind", "dim", "category", "value", "n")


def category_counts(counts: DataFrame) -> DataFrame:
    return of_dimension(counts).groupBy("kind", "category").agg(F.sum("n").alias("n"))


def distributions(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "dim", "value").agg(F.sum("n").alias("n"))


def totals(counts: DataFrame) -> DataFrame:
    """Items per kind. A kind without items has no row."""
    return of_dimension(counts).groupBy("kind").agg(F.sum("n").alias("total_items"))


def distinct_categories(counts: DataFrame) -> DataFrame:
    return category_counts(counts).groupBy("kind").agg(F.count(F.lit(1)).alias("categories"))


# -- top categories (TOP6, TOP7) --------------------------------------------


def top_categories(counts: DataFrame, k: int = vocab.TOP_CATEGORIES) -> DataFrame:
    """The most common categories of each kind; ties go to the one seen first."""
    counted = (
        of_dimension(counts)
        .groupBy("kind", "category")
        .agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    )
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "first_pos", "category")
    return (
        counted.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select("kind", "place", "category", "n")
    )


# -- frequency and impact (JOIN3, AGG6, AGG7, WIN1) -------------------------


def priority_score(priority: Column) -> Column:
    """3, 2, 1 for high, medium, low; anything else, another case too, is 0."""
    score = F.lit(0)
    for name, value in vocab.PRIORITY_SCORES.items():
        score = F.when(priority == name, value).otherwise(score)
    return score


def frequency_impact(counts: DataFrame, kind: str = vocab.PAIN_POINTS) -> DataFrame:
    """Per category of one kind: count, total and mean priority score."""
    score = F.col("n") * priority_score(F.col("value"))
    return (
        of_dimension(counts)
        .where(F.col("kind") == kind)
        .groupBy("category")
        .agg(F.sum("n").alias("frequency"), F.sum(score).alias("total_priority"))
        .withColumn("impact", F.col("total_priority") / F.col("frequency"))
    )


def quadrant_lines(matrix: DataFrame) -> DataFrame:
    """The means over categories, each category counting once."""
    return matrix.agg(
        F.round(F.avg("frequency"), 9).alias("mean_frequency"),
        F.round(F.avg("impact"), 9).alias("mean_impact"),
    )


def with_quadrants(matrix: DataFrame) -> DataFrame:
    """Every category with the quadrant it falls into; on the line counts as high.

    The two means enter as scalar subqueries, so the categories stay distributed. Both
    sides are rounded: sums of fractions differ in the last bit with their order.
    """
    lines = quadrant_lines(matrix)
    placed = matrix.withColumn(
        "mean_frequency", lines.select("mean_frequency").scalar()
    ).withColumn("mean_impact", lines.select("mean_impact").scalar())
    often = F.round(F.col("frequency").cast("double"), 9) >= F.col("mean_frequency")
    severe = F.round("impact", 9) >= F.col("mean_impact")
    quadrant = (
        F.when(severe & often, vocab.QUADRANTS["high", "high"])
        .when(severe, vocab.QUADRANTS["high", "low"])
        .when(often, vocab.QUADRANTS["low", "high"])
        .otherwise(vocab.QUADRANTS["low", "low"])
    )
    return placed.withColumn("quadrant", quadrant)


# -- shares and counters (AGG9-13) ------------------------------------------


def _share(value: str, alias: str) -> Column:
    hits = F.sum(F.when(F.col("value") == value, F.col("n")).otherwise(0))
    return (hits / F.sum("n")).alias(alias)


def high_priority_share(counts: DataFrame) -> DataFrame:
    rows = of_dimension(counts, "priority")
    return rows.groupBy("kind", "category").agg(_share("high", "high_priority_share"))


def high_confidence_share(counts: DataFrame) -> DataFrame:
    rows = of_dimension(counts, "confidence")
    return rows.groupBy("kind").agg(_share("High", "high_confidence_share"))


def threads_per_source(threads: DataFrame) -> DataFrame:
    return threads.groupBy("source").agg(F.count(F.lit(1)).alias("threads"))


def theme_mentions(items: DataFrame, theme: Sequence[str], by: Sequence[str] = ("kind",)) -> DataFrame:
    """Items that name one of the theme's words, out of all."""
    text = F.lower("text")
    named = F.lit(False)
    for word in theme:
        named = named | F.contains(text, F.lit(word.lower()))
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum(F.when(named, 1)), F.lit(0)).alias("mentions"),
    )


def run_counters(threads: DataFrame) -> DataFrame:
    """Threads, and items of each kind, without exploding anything."""

    def entries(kind: str) -> Column:
        return F.sum(F.greatest(F.coalesce(F.size(kind), F.lit(0)), F.lit(0)).cast("bigint"))

    return threads.agg(
        F.count(F.lit(1)).alias("threads"),
        *(F.coalesce(entries(k), F.lit(0)).alias(k) for k in vocab.KINDS),
    )


def bodies(comments: Column) -> Column:
    """The number of comments that have a body."""
    kept = F.size(F.filter(comments, lambda c: c["body"].isNotNull()))
    return F.greatest(F.coalesce(kept, F.lit(0)), F.lit(0)).cast("bigint")


def comments_per_file(threads: DataFrame, file: str = "file_name") -> DataFrame:
    """Comments with a body, per input file (AGG14)."""
    return threads.groupBy(file).agg(F.sum(bodies(F.col("comments"))).alias("comments"))

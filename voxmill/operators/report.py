"""Report tables (RPT1-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.operators import analyze


def pain_point_bars(counts: DataFrame, k: int = vocab.TOP_CATEGORIES) -> DataFrame:
    """Bar-chart rows: the top categories of pain points, largest first (RPT1)."""
    bars = analyze.top_categories(counts.where(F.col("kind") == vocab.PAIN_POINTS), k)
    return bars.select("place", "category", "n").orderBy("place")


def priority_matrix(counts: DataFrame) -> DataFrame:
    """Every pain-point category with frequency, impact and quadrant (RPT2)."""
    return analyze.with_quadrants(analyze.frequency_impact(counts))


def summary(counts: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """All counts of the summary in one long table (RPT3).

    ``section`` is total_items, categories, top_categories or the name of an attribute; with
    ``costs`` (kind, cost) there is a section total_cost, whose ``cost`` is exact and NULL
    where no tokens were named, and whose ``n`` is NULL.
    """

    def rows(frame: DataFrame, section, name, n: str) -> DataFrame:
        return frame.select("kind", section.alias("section"), name.alias("name"), F.col(n).alias("n"))

    none = F.lit(None).cast("string")
    parts = [
        rows(analyze.totals(counts), F.lit("total_items"), none, "total_items"),
        rows(analyze.distinct_categories(counts), F.lit("categories"), none, "categories"),
        rows(
            analyze.distributions(counts),
            F.concat(F.col("dim"), F.lit("_distribution")),
            F.col("value"),
            "n",
        ),
        rows(analyze.top_categories(counts), F.lit("top_categories"), F.col("category"), "n"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    if costs is None:
        return result
    paid = costs.select("kind", F.lit("total_cost").alias("section"), none.alias("name"), F.lit(None).cast("bigint").alias("n"), "cost")
    return result.unionByName(paid, allowMissingColumns=True)


def roadmap(counts: DataFrame) -> DataFrame:
    """Pain-point categories in the order to take them up (RPT4): quadrant, then impact,
    then frequency."""
    urgency = F.lit(len(vocab.QUADRANTS))
    for rank, quadrant in enumerate(vocab.QUADRANTS.values()):
        urgency = F.when(F.col("quadrant") == quadrant, rank).otherwise(urgency)
    return (
        priority_matrix(counts)
        .withColumn("urgency", urgency)
        .orderBy("urgency", F.desc(F.round("impact", 9)), F.desc("frequency"), "category")
        .select("category", "frequency", "impact", "quadrant")
    )

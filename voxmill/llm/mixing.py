"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.session import stored_once

#: Above this mean a count is drawn as the sum of several smaller ones, so that exp() keeps
#: its digits.
PART_MEAN = 64.0
#: Hex digits of a digest that make a uniform number: 52 bits.
DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of ``parts``, the same on every run."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def _cumulative(mean: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... up to where it is 1 in double precision."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), (state["sum"] + p).alias("sum"), F.concat(state["all"], F.array(state["sum"] + p)).alias("all"))

    return F.aggregate(steps, first, step, lambda state: state["all"])


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, rate): how often a document of the source is expected in the mix.

    ``weights`` has source and weight (any positive scale); without it every source gets
    the same. ``total`` is the expected number of documents in the mix, as many as there
    are by default. A source that ``weights`` does not name has rate 0.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    counts = stored_once(counts, "sources")
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        named = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = counts.join(named, F.col("source").eqNullSafe(F.col("named")), "left").fillna({"weight": 0.0})
    sums = weighted.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    n = float(total if total is not None else sums["n"] or 0)
    share = F.col("weight") / F.lit(float(sums["w"] or 1.0))
    return weighted.select("source", (share * F.lit(n) / F.col("n")).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` repeated so that sources have their weights, in a random global order.

    The count of a document is the inverse of the Poisson distribution with its source's
    rate at a number hashed from seed and id (from the text where the id is null), so a
    run gives the same mix again. New columns: ``mix_copy`` (from 1), ``mix_copies`` and
    ``mix_key``, by which rows are dealt to partitions and sorted in them.

    Nothing is gathered by source: the table of rates is small and is joined on; it has a
    row per source, and Spark picks the join by its size on disk. Rows that repeat an id
    get the same count. A null source is a source like any other. An empty table gives an
    empty mix. Columns of ``docs`` with the names of the new ones are replaced.
    """
    new = ("mix_copy", "mix_copies", "mix_key")
    part = F.ceil(F.col("rate") / PART_MEAN).cast("int")
    table = rates(docs, weights, total, source_col).filter("rate > 0").withColumn("parts", part)
    table = table.select(F.col("source").alias("_source"), "parts", _cumulative(F.col("rate") / F.col("parts")).alias("levels"))
    table = stored_once(table, "levels")

    kept = [c for c in docs.columns if c not in new]
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.struct(*kept).alias("_row"), ident.alias("_ident"), F.col(source_col).alias("_of"))
    rows = rows.join(table, F.col("_of").eqNullSafe(F.col("_source")))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda j: F.size(F.filter("levels", lambda level: level <= uniform(F.lit(str(seed)), j.cast("string"), "_ident"))),
    )
    rows = rows.withColumn("mix_copies", F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).filter("mix_copies > 0")
    rows = rows.select("_row", "_ident", "mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), "_ident", "mix_copy")))
    shuffled = rows.repartition("mix_key").sortWithinPartitions("mix_key")
    return shuffled.select("_row.*", *new)

"""Sums over everything that comes before a row, without walking a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.session import stored_once


def running_sums(rows: DataFrame, order: Sequence[str], weights: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with, for each weight, ``<name>``: its sum over the rows before this one in
    ``order`` within ``by``, and ``<name>_total``: its sum over all rows of ``by``.

    The rows are sorted into ranges of (``by``, ``order``) of even size, whatever the values
    and however many rows a group has, and written to the shared folder, so that the ranges
    stay what they are. A window then runs inside each range; the totals of the ranges, one
    small row per group and range, give what a range starts with. Only rows that tie in
    ``order`` may come in any order. Columns of ``by`` may be null. Hand in narrow rows:
    they move twice.
    """
    by, order = list(by), list(order)
    placed = rows.select("*", *(w.alias(f"_w_{n}") for n, w in weights.items()))
    placed = stored_once(placed.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(*(F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights))
    starts = totals.select(
        *(F.col(b).alias(f"_by_{b}") for b in by),
        F.col("_range").alias("_at"),
        *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in weights),
        *(F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in weights),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *(F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)).alias(f"_in_{n}") for n in weights))
    same = F.col("_range") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return summed.join(starts, same).select(
        *(F.col(f"`{c}`") for c in rows.columns),
        *((F.col(f"_in_{n}") + F.col(f"_start_{n}")).alias(n) for n in weights),
        *(f"{n}_total" for n in weights),
    )


def sums_before(df: DataFrame, position: str, weights: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """The same for wide rows: ``position`` is unique within ``by`` and neither is null.

    Only position and weights are sorted; the rows themselves are read once more and meet
    their sums in one join, for which they do not move at all where Spark broadcasts them.
    """
    keys = [*by, position]
    narrow = df.select(*keys, *(w.alias(f"_of_{n}") for n, w in weights.items()))
    sums = running_sums(narrow, [position], {n: F.col(f"_of_{n}") for n in weights}, by).drop(*(f"_of_{n}" for n in weights))
    return df.join(sums, keys).select(*df.columns, *weights, *(f"{n}_total" for n in weights))

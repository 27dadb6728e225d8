"""Cleaning landed thread files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.clean import clean_threads
from voxmill.sinks.tables import cleaned_comments, write_cleaned
from voxmill.sources.threads import read_threads, unreadable_files, unreadable_lines


def clean_files(
    spark: SparkSession,
    path: str,
    out: str,
    product: str | None = None,
    json_lines: bool = False,
    fmt: str = "json",
) -> DataFrame:
    """Write cleaned copies of all thread files in or below ``path``; returns the comments per
    file, counted off the copies. ``out`` may lie below ``path``: copies are no input.

    The files, or the lines, that can't be read go to the parquet table
    ``<out>_quarantine`` (path, reason, text), which is empty where all are sound.
    """
    lost = unreadable_lines(spark, path).withColumn("reason", F.lit("unreadable")) if json_lines else unreadable_files(spark, path)
    lost.select("path", "reason", "text").write.mode("overwrite").parquet(f"{out.rstrip('/')}_quarantine")
    write_cleaned(clean_threads(read_threads(spark, path, json_lines), product), out, fmt)
    return cleaned_comments(spark, out, fmt)

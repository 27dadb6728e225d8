"""Table sinks (SNK1-6). Data is written first and the ledger is read off the data, so a
run that dies in between repeats work but loses nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.analyze import bodies, comments_per_file
from voxmill.sinks.commits import append_once, read_committed, read_if_there


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, with or without commits, or None before the first write."""
    if read_if_there(spark, f"{path}/log", "n_rows bigint") is None:
        return read_if_there(spark, path)
    return read_committed(spark, path)


def append_new(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    *order: str,
    partition_by: str | None = "source",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    commit: str | None = None,
) -> bool:
    """Append what is new (SNK1), as one commit; says whether anything was.

    Rows that lack part of their key are told apart by all they have. The look for new rows
    reads key digests only. Costly work belongs into ``prepare``: it runs on the new rows
    alone, and once. With a ``commit`` of its own a run that is repeated adds nothing.
    """
    parts = (partition_by,) if partition_by else ()
    return append_once(df, path, commit or uuid.uuid4().hex, keys, *order, partition_by=parts, prepare=prepare) > 0


def write_cleaned(threads: DataFrame, path: str, fmt: str = "json") -> dict[str, int]:
    """Cleaned copies, one folder per input file, named after its path (SNK2); gives the
    numbers of threads and of comments with a body, counted as they are written."""
    name = F.regexp_replace("file_name", r"\.json$", "_cleaned")
    seen = Observation()
    counted = threads.withColumn("dataset", name).observe(
        seen, F.count(F.lit(1)).alias("threads"), F.coalesce(F.sum(bodies(F.col("comments"))), F.lit(0)).alias("comments")
    )
    counted.write.mode("overwrite").partitionBy("dataset").format(fmt).save(path)
    return seen.get


def cleaned_comments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """(file_name, comments) of the copies at ``path``, read with nothing but bodies (AGG14)."""
    copies = spark.read.schema("comments array<struct<body string>>, dataset string").format(fmt).load(path)
    named = copies.withColumn("file_name", F.regexp_replace("dataset", "_cleaned$", ".json"))
    return comments_per_file(named)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """The result as a set of tables (SNK3); as JSON, one object per row."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")

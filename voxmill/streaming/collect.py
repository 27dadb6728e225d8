"""Resumable collection: every item once across runs (STR1)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxmill.sinks.commits import append_once, read_if_there


def landed(
    spark: SparkSession,
    path: str,
    schema,
    fmt: str = "json",
    pattern: str | None = None,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """A stream of landed files. The schema is given, never inferred; a backlog is worked
    off in batches of so many files."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def collect(
    stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], *order: str,
    partition_by: str | None = "source",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write rows whose key the sink does not hold yet; drain what has landed and stop.

    Every batch is one commit, named after the checkpoint and the batch. A batch that died
    anywhere is run again by Spark under its number: if its commit is there nothing happens,
    else its own leftovers are written over. What was collected before is looked up in the
    sink's index of key digests, not in the sink, so there is no state inside the query
    and a new checkpoint on an old sink adds nothing twice. ``prepare``, cleaning for one,
    sees the new rows only and keeps the digest columns.
    """
    run = _run_name(stream.sparkSession, checkpoint)
    parts = (partition_by,) if partition_by else ()

    def write(batch: DataFrame, number: int) -> None:
        append_once(batch, sink, f"{run}-{number}", keys, *order, partition_by=parts, prepare=prepare)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """A name kept inside the checkpoint: a new one there starts a new count of batches."""
    path = f"{checkpoint}/run"
    kept = read_if_there(spark, path, "run string")
    if kept is None:
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.parquet(path)
        kept = spark.read.parquet(path)
    return kept.first()["run"]


def collect_within(
    stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], event_time: str, delay: str
) -> StreamingQuery:
    """For feeds whose copies arrive within ``delay``: bounded state instead of a look-up
    in the sink, and exactly-once files."""
    return (
        stream.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(list(keys))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

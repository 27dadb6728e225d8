"""Tables that grow by commits: a commit is there as a whole or not at all, and one that is
run again changes nothing.

``<path>/data/commit=c<id>``              rows of a commit, with the digest of each row's key
``<path>/index/bucket=<b>/commit=c<id>``  the digests alone, dealt to buckets by their value
``<path>/log/commit=c<id>``               written last; what has no entry here is not read

A run that dies leaves data without an entry in the log. Run again under the same id it
writes over them; under another id they are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators.select import first_per_key

#: Buckets of a new table's index. More of them make a small batch's look-up smaller.
BUCKETS = 16
_DIGEST = ("_key1", "_key2")


_LOG, _META, _INDEX = "n_rows bigint, commit string", "buckets int", "_key1 bigint, _key2 bigint, bucket int, commit string"


def read_if_there(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    """The parquet table at ``path``, or None where there is none yet. With a ``schema`` no
    file is opened to find out."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _named(commit: str) -> str:
    """The folder's value; never a number, or the leading noughts of one would be lost."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", commit):
        raise ValueError(f"not a name for a commit: {commit!r}")
    return f"c{commit}"


def is_committed(spark: SparkSession, path: str, commit: str) -> bool:
    """Looks at one folder, however long the log is."""
    return read_if_there(spark, f"{path}/log/commit={_named(commit)}", "n_rows bigint") is not None


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """(commit, n_rows) of all commits, or None before the first."""
    log = read_if_there(spark, f"{path}/log", _LOG)
    return None if log is None else log.select(F.substring("commit", 2, 2**31 - 1).alias("commit"), "n_rows")


def _done(log: DataFrame) -> DataFrame:
    """One small row per commit; Spark broadcasts them as long as they are few."""
    return log.select(F.concat(F.lit("c"), "commit").alias("_done"))


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all commits; None before the first one. One without rows leaves no data."""
    log = commits(spark, path)
    rows = None if log is None else read_if_there(spark, f"{path}/data")
    if rows is None:
        return None
    return rows.join(_done(log), F.col("commit") == F.col("_done"), "left_semi").drop("commit", *_DIGEST)


def with_digests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with two 64-bit digests of their key. A row that lacks part of its key has
    the whole row as its key: rows without an id are not copies of each other."""
    lacking = F.lit(False)
    for key in keys:
        lacking = lacking | F.col(key).isNull()
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))

    def digest(seed: int) -> Column:
        return F.when(lacking, F.xxhash64(F.lit(seed), F.lit("row"), whole)).otherwise(F.xxhash64(F.lit(seed), *keys))

    return rows.select("*", *(digest(k).alias(n) for k, n in enumerate(_DIGEST)))


def _bucket(buckets: int) -> Column:
    return F.pmod(_DIGEST[0], F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str, wanted: int) -> int:
    """The number of buckets of the table, set down by whoever comes first."""
    meta = read_if_there(spark, f"{path}/meta", _META)
    if meta is not None:
        return meta.first()["buckets"]
    spark.createDataFrame([(wanted,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return wanted


def known_digests(rows: DataFrame, path: str, buckets: int) -> DataFrame | None:
    """Digests that committed rows have, read from the buckets that ``rows`` fall into: at
    most ``buckets`` numbers come to the driver, and no file of another bucket is opened."""
    spark = rows.sparkSession
    log, index = commits(spark, path), read_if_there(spark, f"{path}/index", _INDEX)
    if log is None or index is None:
        return None
    touched = sorted(r[0] for r in rows.select(_bucket(buckets).alias("b")).distinct().collect())
    mine = index.where(F.col("bucket").isin(touched))
    return mine.join(_done(log), F.col("commit") == F.col("_done"), "left_semi").select(*_DIGEST)


def commit_rows(rows: DataFrame, path: str, commit: str, partition_by: Sequence[str] = (), buckets: int | None = None) -> int:
    """Write ``rows`` as one commit and give their number. ``rows`` are evaluated once; with
    ``buckets`` they have digests, and the index is read off what was written."""
    spark = rows.sparkSession
    data = f"{path}/data/commit={_named(commit)}"
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*partition_by).parquet(data)
    n = seen.get["n"]
    if n and buckets is not None:
        # A bucket's digests in one file; a bucket is a small share of 16 bytes a row.
        index = spark.read.schema("_key1 bigint, _key2 bigint").parquet(data).select(*_DIGEST, _bucket(buckets).alias("bucket"), F.lit(_named(commit)).alias("commit"))
        index.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "commit").parquet(f"{path}/index")
    log = spark.createDataFrame([(n,)], "n_rows bigint").coalesce(1)
    log.write.mode("overwrite").parquet(f"{path}/log/commit={_named(commit)}")
    return n


def append_once(
    rows: DataFrame, path: str, commit: str, keys: Sequence[str], *order: str, partition_by: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
) -> int:
    """Commit the rows whose key no commit has yet, and of each new key the first in
    ``order``; gives their number, 0 where ``commit`` is there already.

    The look-up reads digests, never the table. Known rows go before anything is sorted.
    ``prepare`` sees new rows only and keeps all it is not asked to change, digests included.
    One writer at a time, as with a stream.
    """
    spark = rows.sparkSession
    if is_committed(spark, path, commit):
        return 0
    buckets = _buckets(spark, path, buckets)
    marked = with_digests(rows, keys)
    known = known_digests(marked, path, buckets)
    if known is not None:
        marked = marked.join(known, list(_DIGEST), "left_anti")
    new = first_per_key(marked, _DIGEST, *order) if order else marked.dropDuplicates(list(_DIGEST))
    if prepare is not None:
        changed = prepare(new)
        if not set(_DIGEST) <= set(changed.columns):
            raise ValueError(f"prepare must keep the columns {', '.join(_DIGEST)}")
        new = changed
    return commit_rows(new, path, commit, partition_by, buckets)


def compact(spark: SparkSession, path: str, out: str, buckets: int, partition_by: Sequence[str] = ()) -> None:
    """A copy of the table at ``out`` with one commit and ``buckets`` buckets, for when
    commits have become many or buckets large. Readers and writers go over to it."""
    rows = read_if_there(spark, f"{path}/data")
    log = commits(spark, path)
    if rows is None or log is None:
        return
    whole = rows.join(_done(log), F.col("commit") == F.col("_done"), "left_semi").drop("commit")
    commit_rows(whole, out, "compacted", partition_by, _buckets(spark, out, buckets))

"""Reading thread files and analysed threads (SRC1-3, SRC7, SRC8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import schemas, vocab
from voxmill.sources.arrays import read_array_elements
from voxmill.sources.files import json_inputs

# Folders are read with all that lies below them.
_FILES = {"pathGlobFilter": "*.json", "recursiveFileLookup": True}
_KNOWN = (
    "source", "thread_id", "issue_id", "url", "title", "author", "created_at", "comments",
    "issue_number", "state", "labels", "score", "num_comments", "reply_count", "views",
)


def _array_files(spark: SparkSession, path: str) -> DataFrame:
    """(document, text) of every array file (UTF-8): its elements, each a VARIANT of its
    own, so a file has no such limit. ``document`` is NULL where the text is not one list
    or an element of it can't be read."""
    texts = json_inputs(spark.read.text(path, wholetext=True, **_FILES), path)
    text = F.regexp_replace("value", "^\ufeff", "")
    # In one more pair of brackets, or what follows the first list would be ignored.
    roots = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<variant>>")
    files = texts.select(roots.alias("roots"), text.alias("text"), "file_name", "file_path")
    list_ = F.get("roots", F.lit(0))
    whole = (F.size("roots") == 1) & ~F.exists(list_, lambda element: element.isNull())
    return files.select(F.when(whole, list_).alias("document"), "text", "file_name", "file_path")


def read_records(spark: SparkSession, path: str, json_lines: bool = False, split: bool = False) -> DataFrame:
    """Every record of every ``*.json`` file in or below ``path`` that is no cleaned copy, as
    VARIANT; ``file_name`` is the file's path below ``path``.

    VARIANT takes records of any shape, so one odd record cannot spoil its file. A JSON
    array file is read in one task, up to 2 GB. With ``split`` it is cut between its elements
    and read by many, whatever its size, for a few passes more: the choice for large files.
    """
    if split and not json_lines:
        return read_array_elements(spark, path)[0]
    if json_lines:
        lines = spark.read.options(singleVariantColumn="record", **_FILES).json(path)
        # A line that is no JSON is in quarantine (unreadable_lines), not a thread.
        return json_inputs(lines, path).where(F.col("record").isNotNull()).select("record", "file_name")
    files = _array_files(spark, path)
    return files.select("file_name", F.posexplode("document").alias("pos", "record")).select("record", "file_name", "pos")


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason, text) of the array files that :func:`read_records` can't take records
    from: broken JSON or an element that no VARIANT holds ("unreadable"), or a root that is
    no list. A feed that has such files is not whole."""
    bad = _array_files(spark, path).where(F.col("document").isNull())
    no_list = F.try_parse_json("text").isNotNull() & ~F.startswith(F.ltrim("text"), F.lit("["))
    reason = F.when(no_list, "no list").otherwise("unreadable")
    return bad.select(F.col("file_path").alias("path"), reason.alias("reason"), "text")


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the lines of JSON lines files that are no JSON."""
    lines = json_inputs(spark.read.text(path, **_FILES), path)
    broken = F.try_parse_json("value").isNull() & (F.trim("value") != "")
    return lines.where(broken).select(F.col("file_path").alias("path"), F.col("value").alias("text"))


def _comment(comment: Column) -> Column:
    """A comment record; a body that is no text counts as missing."""

    def field(name: str) -> Column:
        return F.try_variant_get(comment, f"$.{name}", "string")

    is_text = F.schema_of_variant(F.try_variant_get(comment, "$.body", "variant")) == "STRING"
    return F.struct(
        field("comment_id").alias("comment_id"),
        field("author").alias("author"),
        F.try_to_timestamp(field("created_at")).alias("created_at"),
        F.when(is_text, field("body")).alias("body"),
    )


def as_threads(records: DataFrame) -> DataFrame:
    """Records as typed threads.

    A record that is no object, or has no comments, stays as a row without comments.
    Fields outside the schema are kept as JSON in ``extra``.
    """
    record = F.col("record")

    def field(name: str, type_: str = "string") -> Column:
        return F.try_variant_get(record, f"$.{name}", type_)

    fields = F.try_variant_get(record, "$", "map<string,variant>")
    extra = F.map_filter(fields, lambda name, _: ~name.isin(list(_KNOWN)))
    comments = F.transform(field("comments", "array<variant>"), _comment)
    kept = [c for c in records.columns if c != "record"]
    return records.select(
        F.coalesce(field("source"), F.lit(vocab.UNKNOWN_SOURCE)).alias("source"),
        F.coalesce(field("thread_id"), field("issue_id")).alias("thread_id"),
        field("url").alias("url"),
        field("title").alias("title"),
        field("author").alias("author"),
        F.try_to_timestamp(field("created_at")).alias("created_at"),
        comments.alias("comments"),
        field("issue_number", "bigint").alias("issue_number"),
        field("state").alias("state"),
        field("labels", "array<string>").alias("labels"),
        *(field(n, "bigint").alias(n) for n in ("score", "num_comments", "reply_count", "views")),
        F.to_json(extra).alias("extra"),
        *kept,
    )


def read_threads(spark: SparkSession, path: str, json_lines: bool = False, split: bool = False) -> DataFrame:
    return as_threads(read_records(spark, path, json_lines, split))


def read_analysed(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Analysed threads with their two lists; a missing list is NULL."""
    return spark.read.schema(schemas.ANALYSED_THREAD).option("multiLine", not json_lines).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored categorised items; all reports are computed again from these."""
    return spark.read.parquet(path)

"""JSON array files cut between their elements, so that many tasks read one file (SRC1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.numbering import running_sums
from voxmill.session import stored_once
from voxmill.sources.files import json_inputs

_PLACE = ["start", "at"]
#: Elements between two objects of a file's list that a position has room for.
_SPAN = 2**31


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, start, at, value): files cut at every closing brace, in the byte ranges
    in which Spark deals them to tasks. ``start`` and ``at`` give their order in the file."""
    texts = spark.read.option("lineSep", "}").text(path, pathGlobFilter="*.json", recursiveFileLookup=True)
    rows = json_inputs(texts.withColumn("start", F.col("_metadata.file_block_start")), path).select("file_path", "file_name", "start", F.monotonically_increasing_id().alias("at"), "value")
    # Written, since another reading might deal other ranges.
    return stored_once(rows, "fragments")


def _depth_change(text: Column, inside: int) -> Column:
    """Brackets opened less brackets closed outside of strings, in a text without escapes
    that begins outside (0) or inside (1) of a string."""
    outside = F.array_join(F.filter(F.split(text, '"'), lambda _, k: k % 2 == inside), "")
    return F.regexp_count(outside, F.lit(r"[\{\[]")) - F.regexp_count(outside, F.lit(r"\]"))


def _located(fragments: DataFrame) -> DataFrame:
    """(file_path, start, at, piece, last, sound): which piece of its file a fragment belongs
    to, whether it is the file's last, and whether the file's brackets come out even.

    Whether a fragment begins inside a string depends on all quotes before it, its depth on
    all brackets before it, and its piece on all elements that ended before it: three running
    sums over the file, each taken over ranges of even size. Texts stay where they are."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    rows = fragments.select("file_path", *_PLACE, bare.alias("bare")).select(
        "file_path", *_PLACE, F.regexp_count("bare", F.lit('"')).alias("quotes"), _depth_change(F.col("bare"), 0).alias("d0"), _depth_change(F.col("bare"), 1).alias("d1")
    )
    rows = running_sums(rows, _PLACE, {"q": F.col("quotes"), "nth": F.lit(1)}, ["file_path"])
    last = F.col("nth") + 1 == F.col("nth_total")
    closes = ~last & ((F.col("q") + F.col("quotes")) % 2 == 0)
    delta = F.when(F.col("q") % 2 == 0, F.col("d0")).otherwise(F.col("d1")) - closes.cast("int")
    rows = rows.select("file_path", *_PLACE, last.alias("last"), closes.alias("closes"), delta.alias("delta"))
    rows = running_sums(rows, _PLACE, {"depth": F.col("delta")}, ["file_path"])
    ends = F.col("closes") & (F.col("depth") + F.col("delta") == 1)
    rows = rows.select("file_path", *_PLACE, "last", ends.cast("int").alias("ends"), (F.col("depth_total") == 0).alias("sound"))
    return running_sums(rows, _PLACE, {"piece": F.col("ends")}, ["file_path"]).select("file_path", *_PLACE, "piece", "last", "sound")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, piece, elements): every file's list in pieces that end with an
    object of it; ``elements`` is NULL where a piece can't be read."""
    fragments = _fragments(spark, path)
    rows = fragments.join(_located(fragments), ["file_path", *_PLACE])
    parts = rows.groupBy("file_path", "file_name", "piece").agg(
        F.sort_array(F.collect_list(F.struct(*_PLACE, "value"))).alias("parts"), F.max("last").alias("last"), F.min("sound").alias("sound")
    )
    text = F.concat(F.array_join("parts.value", "}"), F.when(F.col("last"), "").otherwise("}]"))
    text = F.when(F.col("piece") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    parts = parts.select("file_path", "file_name", "piece", "sound", text.alias("text"))
    # What follows the first piece begins with a comma, or is the closing bracket alone.
    listed = (
        F.when(F.col("piece") == 0, F.col("text"))
        .when(F.trim(F.translate("text", "\n\r\t", "   ")) == "]", "[]")
        .when(F.rlike("text", F.lit(r"^\s*,\s*[^\s\]]")), F.regexp_replace("text", r"^\s*,", "["))
    )
    roots = F.from_json(F.concat(F.lit("["), listed, F.lit("]")), "array<array<variant>>")
    parsed = parts.select("file_path", "file_name", "piece", "sound", roots.alias("roots"))
    list_ = F.get("roots", F.lit(0))
    whole = F.col("sound") & (F.size("roots") == 1) & ~F.exists(list_, lambda element: element.isNull())
    return parsed.select("file_path", "file_name", "piece", F.when(whole, list_).alias("elements"))


def read_array_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The elements of all JSON array files (record VARIANT, file_name, pos) and the files that
    are no sound lists (path, reason); cleaned copies are passed over.

    A file is read in byte ranges of spark.sql.files.maxPartitionBytes, so its size is no
    limit, only that of one element. ``pos`` rises in file order, with gaps. A file with
    anything that can't be read gives no element: it is reported as a whole.
    """
    pieces = stored_once(_pieces(spark, path), "pieces")
    bad = pieces.where(F.col("elements").isNull()).select(F.col("file_path").alias("path")).distinct()
    sound = pieces.join(bad, pieces["file_path"] == bad["path"], "left_anti")
    records = sound.select("file_name", "piece", F.posexplode("elements").alias("nth", "record"))
    pos = (F.col("piece") * F.lit(_SPAN) + F.col("nth")).alias("pos")
    return records.select("record", "file_name", pos), bad.withColumn("reason", F.lit("unreadable"))

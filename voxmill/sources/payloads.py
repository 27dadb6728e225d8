"""Normalising raw payloads to threads (SRC4-6, SRC9).

Each normaliser is one projection: no explode, no shuffle. A record that cannot be
normalised is not lost; its ``problem`` says why and it goes to quarantine.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill import schemas, vocab
from voxmill.functions import scalars
from voxmill.functions.text import or_empty, strip
from voxmill.operators.items import first_post_then_replies, with_body
from voxmill.session import fresh_dir

_CORRUPT = "_corrupt_record"
_RAW = "_raw"
#: Columns by which a landed text is found again.
DIGEST = ("_text1", "_text2")
_NO_COMMENTS = f"CAST(array() AS {schemas.COMMENTS})"


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed payloads, one JSON object per line. Unreadable lines keep their text."""
    return (
        spark.read.schema(f"{schema}, {_CORRUPT} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )


def parse_payloads(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for payloads that are a text column of a table.

    ``inline`` keeps the optimizer from parsing the text once per field that is read.
    """
    parsed = F.from_json(column, f"{schema}, {_CORRUPT} STRING")
    return df.select(F.inline(F.array(parsed)))


def _digests(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in enumerate(DIGEST)]


class Sifted(NamedTuple):
    """Landed texts after one pass: what can be ranked, what can't, and how many of each."""

    sound: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def sift(landed: DataFrame, text: str, schema: str, version: str | Column | None, **checks: Column) -> Sifted:
    """Part sound payloads from the others (SRC9), reading and parsing each text once.

    ``schema`` names the few fields that are ranked on; the rest of a text is skipped over,
    not built. Sound rows are those fields, ``version`` and a 128-bit digest of the text, by
    which ``reread`` finds it again. The quarantine has every row that fails a check, or is
    no JSON of that shape, with its whole text. Both lie in one stored table, in partitions
    of their own, and are counted as they are written. ``checks`` are named after the
    problem. No rows give empty tables.
    """
    spark = landed.sparkSession
    if version is None:
        version = F.lit(None).cast("long")
    version = F.col(version) if isinstance(version, str) else version
    parsed = landed.select(F.col(text).alias(_RAW), version.alias("_version")).select(
        _RAW, "_version", F.inline(F.array(F.from_json(_RAW, f"{schema}, {_CORRUPT} STRING")))
    )
    problem = _problem(parsed, **checks)
    fields = [c for c in parsed.columns if c not in (_RAW, _CORRUPT)]
    rows = parsed.select(*fields, *_digests(_RAW), problem.alias("problem"), _RAW).select(
        *fields, *DIGEST, "problem",
        F.when(F.col("problem").isNotNull(), F.col(_RAW)).alias("raw"),
        F.col("problem").isNull().alias("sound"),
    )
    path, seen = fresh_dir(spark, "sifted"), Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("landed"), F.count("problem").alias("quarantined"))
    counted.write.partitionBy("sound").parquet(path)
    # With its schema given, a table without rows, and so without files, can be read too.
    stored = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])).parquet(path)
    return Sifted(
        stored.where("sound").select(*fields, *DIGEST),
        stored.where("NOT sound").select(F.col("id").cast("string").alias("thread_id"), "problem", "raw"),
        seen.get,
    )


def latest(sound: DataFrame, *order: str | Column) -> DataFrame:
    """The last version of every id: by ``_version``, then ``order``, then digest. Numbers and
    short fields move, one row per id and task, never a text."""
    fields = [c for c in sound.columns if c != "id"]
    at = F.struct("_version", *order, *DIGEST)
    return sound.groupBy("id").agg(F.max_by(F.struct(*fields), at).alias("last")).select("id", "last.*")


def reread(landed: DataFrame, text: str, winners: DataFrame, schema: str) -> DataFrame:
    """The winners' texts, found again by digest and parsed whole, copies once. Spark picks
    the join by the number of winners; nothing but the winners is parsed."""
    keyed = landed.select(F.col(text).alias(_RAW), *_digests(text))
    found = keyed.join(winners.select(*DIGEST), list(DIGEST)).dropDuplicates(list(DIGEST))
    parsed = F.from_json(_RAW, f"{schema}, {_CORRUPT} STRING")
    return found.select(_RAW, F.inline(F.array(parsed)))


def _comment(comment_id: Column, author: Column, created_at: Column, body: Column) -> Column:
    return F.struct(
        comment_id.cast("string").alias("comment_id"),
        author.alias("author"),
        created_at.alias("created_at"),
        body.alias("body"),
    )


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _problem(payloads: DataFrame, **checks: Column) -> Column:
    """Name of the first check that fails, NULL where none does."""
    if _CORRUPT in payloads.columns:
        checks = {"unreadable": F.col(_CORRUPT).isNotNull(), **checks}
    first = F.lit(None).cast("string")
    for name, failed in reversed(checks.items()):
        first = F.when(failed, name.replace("_", " ")).otherwise(first)
    return first


def _trace(payloads: DataFrame, problem: Column) -> list[Column]:
    """Why a record is no thread and, where it was kept, the text it came from."""
    kept = [F.when(problem.isNotNull(), F.col(_RAW)).alias("raw")] if _RAW in payloads.columns else []
    return [problem.alias("problem"), *kept]


def _replies(items: str, build) -> Column:
    return F.coalesce(F.transform(items, build), F.expr(_NO_COMMENTS))


def normalise_issues(payloads: DataFrame) -> DataFrame:
    """Issues: the body is comment 0, then the comments in their order."""
    created = scalars.parse_iso(F.col("created_at"))
    opening = _comment(
        F.lit(vocab.ISSUE_BODY_COMMENT_ID), F.col("user.login"), created, or_empty(F.col("body"))
    )
    replies = _replies(
        "comment_list",
        lambda c: _comment(
            c["id"], c["user"]["login"], scalars.parse_iso(c["created_at"]), or_empty(c["body"])
        ),
    )
    problem = _problem(
        payloads,
        no_id=F.col("id").isNull(),
        no_author=F.col("user.login").isNull(),
        no_time=created.isNull(),
        comment_without_author=_any(F.col("comment_list"), lambda c: c["user"]["login"].isNull()),
        comment_without_time=_any(
            F.col("comment_list"), lambda c: scalars.parse_iso(c["created_at"]).isNull()
        ),
    )
    return payloads.select(
        F.lit(vocab.GITHUB).alias("source"),
        F.col("id").cast("string").alias("thread_id"),
        F.col("html_url").alias("url"),
        "title",
        F.col("user.login").alias("author"),
        created.alias("created_at"),
        first_post_then_replies(opening, replies).alias("comments"),
        F.col("number").alias("issue_number"),
        "state",
        F.transform("labels", lambda label: label["name"]).alias("labels"),
        *_trace(payloads, problem),
    )


def normalise_posts(payloads: DataFrame) -> DataFrame:
    """Posts: the post itself, then every comment that has a body."""
    created = scalars.from_epoch(F.col("created_utc"))
    author = scalars.post_author(F.col("author"))
    opening = _comment(F.col("id"), author, created, or_empty(F.col("selftext")))
    replies = F.coalesce(
        F.transform(
            with_body(F.col("comment_list")),
            lambda c: _comment(
                c["id"],
                scalars.post_author(c["author"]),
                scalars.from_epoch(c["created_utc"]),
                c["body"],
            ),
        ),
        F.expr(_NO_COMMENTS),
    )
    problem = _problem(
        payloads,
        no_id=F.col("id").isNull(),
        no_time=F.col("created_utc").isNull(),
        comment_without_time=_any(
            with_body(F.col("comment_list")), lambda c: c["created_utc"].isNull()
        ),
    )
    return payloads.select(
        F.lit(vocab.REDDIT).alias("source"),
        F.col("id").alias("thread_id"),
        scalars.post_url(F.col("permalink")).alias("url"),
        "title",
        author.alias("author"),
        created.alias("created_at"),
        first_post_then_replies(opening, replies).alias("comments"),
        "score",
        "num_comments",
        *_trace(payloads, problem),
    )


def normalise_topics(payloads: DataFrame, base_url: str) -> DataFrame:
    """Topics: the posts as they are. The author is the last poster, not the creator."""
    created = scalars.parse_iso(F.col("created_at"))
    posts = F.col("post_stream.posts")
    comments = F.coalesce(
        F.transform(
            posts,
            lambda p: _comment(
                p["id"],
                scalars.topic_author(p["username"]),
                scalars.parse_iso(p["created_at"]),
                strip(or_empty(p["cooked"])),
            ),
        ),
        F.expr(_NO_COMMENTS),
    )
    problem = _problem(
        payloads,
        no_id=F.col("id").isNull(),
        no_slug=F.col("slug").isNull(),
        no_title=F.col("title").isNull(),
        no_time=created.isNull(),
        post_without_id=_any(posts, lambda p: p["id"].isNull()),
        post_without_time=_any(posts, lambda p: scalars.parse_iso(p["created_at"]).isNull()),
    )
    return payloads.select(
        F.lit(vocab.DISCOURSE).alias("source"),
        F.col("id").cast("string").alias("thread_id"),
        scalars.topic_url(base_url, F.col("slug"), F.col("id").cast("string")).alias("url"),
        "title",
        scalars.topic_author(F.col("last_poster_username")).alias("author"),
        created.alias("created_at"),
        comments.alias("comments"),
        scalars.nested_or(F.col("reply_count"), 0).alias("reply_count"),
        scalars.nested_or(F.col("views"), 0).alias("views"),
        *_trace(payloads, problem),
    )


def sound(normalised: DataFrame) -> DataFrame:
    return normalised.where(F.col("problem").isNull()).drop("problem", "raw")


def quarantine(normalised: DataFrame) -> DataFrame:
    """What could not be normalised, with the reason."""
    return normalised.where(F.col("problem").isNotNull())

"""Replies of a model that were landed as a table (kind, batch_num, reply, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.binding import let
from voxmill.functions.scalars import token_cost
from voxmill.functions.text import strip_json_fence
from voxmill.operators.classify import ANSWERED, MISMATCHED, SURPLUS, UNANSWERED
from voxmill.schemas import MODEL_REPLY


def parse_reply(reply: Column) -> Column:
    """A reply as an array of answers; NULL where it is not a JSON array (JSN1)."""
    return let(
        strip_json_fence(reply),
        lambda text: F.when(
            F.startswith(text, F.lit("[")) & F.endswith(F.rtrim(text), F.lit("]")), F.from_json(text, MODEL_REPLY)
        ),
    )


def parsed_replies(replies: DataFrame) -> DataFrame:
    return replies.withColumn("answers", parse_reply(F.col("reply")))


def failed_replies(replies: DataFrame) -> DataFrame:
    """Replies that could not be read. Their items stay pending."""
    return parsed_replies(replies).where(F.col("answers").isNull()).drop("answers")


def attach_replies(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """Answer *i* of a batch beside item *i* of the batch (JOIN2, CAT2).

    ``status`` says what came of it: an answer that echoes another text, an item without
    an answer and an answer without an item are marked, none is lost or mixed up.
    """
    answers = (
        replies.select(
            "kind",
            "batch_num",
            F.posexplode(parse_reply(F.col("reply"))).alias("pos_in_batch", "answer"),
        )
        .select(
            "kind",
            "batch_num",
            "pos_in_batch",
            F.col("answer.text").alias("echo"),
            F.col("answer.category").alias("category"),
            F.col("answer.confidence").alias("confidence"),
            F.col("answer.reasoning").alias("reasoning"),
            F.lit(True).alias("_answered"),
        )
    )
    joined = batched.withColumn("_asked", F.lit(True)).join(
        answers, ["kind", "batch_num", "pos_in_batch"], "full_outer"
    )
    status = (
        F.when(F.col("_answered").isNull(), UNANSWERED)
        .when(F.col("_asked").isNull(), SURPLUS)
        .when(F.col("echo") != F.col("text"), MISMATCHED)
        .otherwise(ANSWERED)
    )
    return joined.withColumn("status", status).drop("_asked", "_answered")


def total_cost(replies: DataFrame) -> DataFrame:
    """Cost of all batches, failed ones included (MTH3, AGG8)."""
    cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return replies.agg(
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("total_cost"),
    )

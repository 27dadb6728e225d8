"""Items, batches, prompts, token and cost estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions import scalars
from voxmill.operators import items
from workload import views
from workload.registry import query

ANALYSED = f"WITH {views.ANALYSED_SQL}"


@query(
    "arr1_explode_items",
    f"{ANALYSED} SELECT item_id, kind, list_pos, text FROM batched",
)
def arr1(spark, sf):
    return views.exploded(spark, sf).select(
        "item_id", "kind", F.col("list_pos").cast("bigint").alias("list_pos"), "text"
    )


@query(
    "prj7_thread_metadata",
    f"""{ANALYSED} SELECT kind, source, sentiment, priority, user_type, count(*) AS n FROM exploded GROUP BY ALL""",
)
def prj7(spark, sf):
    return (
        views.exploded(spark, sf)
        .groupBy("kind", "source", "sentiment", "priority", "user_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "arr2_post_and_replies",
    """WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
    SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) - 1 AS pos FROM split""",
)
def arr2(spark, sf):
    """The first line is the post, the others are its replies."""
    lines = F.split("text", "\n", -1)
    replies = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    comments = items.first_post_then_replies(F.element_at(lines, 1), replies)
    flat = views.table(spark, sf, "documents").select("doc_id", F.posexplode(comments).alias("pos", "body"))
    return flat.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "arr2_comment_pages",
    """SELECT conv_id AS thread_id, turn // 4 AS page, count(*) AS comments,
    string_agg(text, '|' ORDER BY turn) AS bodies FROM conversations GROUP BY 1, 2""",
)
def arr2_pages(spark, sf):
    flat = views.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), F.col("text").alias("body")
    )
    return items.comment_pages(flat, 4).select(
        "thread_id",
        "page",
        F.size("comments").cast("bigint").alias("comments"),
        F.array_join("comments.body", "|").alias("bodies"),
    )


@query(
    "arr3_batches",
    f"{ANALYSED} SELECT item_id, kind, item_index, batch_num, pos_in_batch, total_batches FROM numbered",
)
def arr3(spark, sf):
    return views.batched(spark, sf).select(
        "item_id",
        "kind",
        "item_index",
        "batch_num",
        F.col("pos_in_batch").cast("bigint").alias("pos_in_batch"),
        "total_batches",
    )


LISTS_SQL = f"""{ANALYSED}, lists AS (
  SELECT kind, batch_num, count(*) AS n_items,
         string_agg((pos_in_batch + 1) || '. ' || text, chr(10) ORDER BY pos_in_batch) AS item_list
  FROM numbered GROUP BY ALL)"""


@query("arr4_numbered_list", f"{LISTS_SQL} SELECT kind, batch_num, item_list FROM lists")
def arr4(spark, sf):
    grouped = (
        views.batched(spark, sf)
        .groupBy("kind", "batch_num")
        .agg(F.array_sort(F.collect_list(F.struct("pos_in_batch", "text"))).alias("entries"))
    )
    return grouped.select(
        "kind", "batch_num", items.numbered_list(F.col("entries.text")).alias("item_list")
    )


def _head(kind: str) -> str:
    categories = "\n".join(f"- {c}" for c in vocab.VOCABULARY[kind])
    words = kind.replace("_", " ")
    return views.quoted(
        vocab.PROMPT_HEAD.format(
            product=views.PRODUCT, kind=kind, kind_words=words, categories=categories
        )
    )


PROMPTS_SQL = f"""{LISTS_SQL}, prompts AS (
  SELECT kind, batch_num, n_items, CASE kind WHEN 'pain_points' THEN {_head("pain_points")}
         ELSE {_head("feature_requests")} END || item_list || {views.quoted(vocab.PROMPT_TAIL)} AS prompt
  FROM lists)"""


@query("txt18_prompts", f"{PROMPTS_SQL} SELECT kind, batch_num, n_items, prompt FROM prompts")
def txt18(spark, sf):
    return views.batch_prompts(spark, sf)


@query(
    "prj8_vocabulary",
    f"""{ANALYSED} SELECT kind, CASE kind WHEN 'pain_points' THEN
      {views.quoted(chr(10).join(f"- {c}" for c in vocab.PAIN_POINT_CATEGORIES))} ELSE
      {views.quoted(chr(10).join(f"- {c}" for c in vocab.FEATURE_REQUEST_CATEGORIES))} END AS vocabulary,
      count(*) AS n FROM exploded GROUP BY 1, 2""",
)
def prj8(spark, sf):
    counted = views.exploded(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("vocabulary", items.vocabulary_list(F.col("kind")))


@query("mth1_tokens", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def mth1(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", scalars.estimate_tokens(F.col("text")).alias("tokens")
    )


@query(
    "mth2_estimated_cost",
    f"""{PROMPTS_SQL} SELECT kind, batch_num,
    CAST((length(prompt) // 4) * 3 + n_items * 50 * 12 AS DOUBLE) / 1000000 AS cost FROM prompts""",
)
def mth2(spark, sf):
    cost = scalars.estimate_batch_cost(F.col("prompt"), F.col("n_items"))
    return views.batch_prompts(spark, sf).select("kind", "batch_num", cost.cast("double").alias("cost"))


@query(
    "mth3_actual_cost",
    f"""{ANALYSED} SELECT kind, batch_num,
    CAST(sum(length(text) // 4) * 3 + count(*) * 50 * 12 AS DOUBLE) / 1000000 AS cost
    FROM numbered GROUP BY 1, 2""",
)
def mth3(spark, sf):
    cost = scalars.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    landed = views.replies(views.batched(spark, sf))
    return landed.select("kind", "batch_num", cost.cast("double").alias("cost"))

"""Filters, engagement, candidate lists, ledger and stored threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.functions import scalars
from voxmill.operators import ledger, select
from voxmill.session import fresh_dir
from voxmill.sinks.tables import append_new, stored
from workload import views
from workload.registry import query

ISSUES = f"WITH {views.ISSUES_SQL}"
OPEN = f"""{ISSUES}, open_issues AS (
  SELECT * FROM issues WHERE state = 'O' AND pull_request IS NULL
  AND updated_at >= TIMESTAMP '{views.AS_OF}' - INTERVAL 180 DAYS)"""


@query("flt1_open_issues", f"{ISSUES} SELECT id, state FROM issues WHERE state = 'O'")
def flt1(spark, sf):
    return select.open_only(views.issues(spark, sf), value="O").select("id", "state")


@query("flt2_no_pull_requests", f"{ISSUES} SELECT id FROM issues WHERE pull_request IS NULL")
def flt2(spark, sf):
    return select.without_pull_requests(views.issues(spark, sf)).select("id")


@query(
    "flt3_recent",
    f"{ISSUES} SELECT id, comments FROM issues WHERE updated_at >= TIMESTAMP '{views.CUTOFF}'",
)
def flt3(spark, sf):
    return select.recent(views.issues(spark, sf), "updated_at", views.as_of()).select("id", "comments")


@query(
    "flt4_categories",
    f"WITH {views.TOPICS_SQL} SELECT * FROM topics WHERE category IN ('error', 'click')",
)
def flt4(spark, sf):
    return select.in_categories(views.topics(spark, sf), "category", ("error", "click"))


@query(
    "flt6_not_collected",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def flt6(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "source")
    return ledger.not_in_ledger(docs, views.table(spark, sf, "labels"), ["doc_id"])


@query(
    "join1_ledger_anti_join",
    """SELECT source, doc_id AS item_id FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)""",
)
def join1(spark, sf):
    docs = views.table(spark, sf, "documents").select("source", F.col("doc_id").alias("item_id"))
    done = views.table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("item_id"))
    return ledger.not_in_ledger(docs, done, ["item_id"])


@query("flt7_one_source", "SELECT doc_id, n_chars FROM documents WHERE source = 'src7'")
def flt7(spark, sf):
    return select.of_source(views.table(spark, sf, "documents"), "src7").select("doc_id", "n_chars")


@query("prj1_issue_engagement", f"{ISSUES} SELECT id, reactions + comments AS engagement FROM issues")
def prj1(spark, sf):
    score = scalars.issue_engagement(F.col("reactions"), F.col("comments"))
    return views.issues(spark, sf).select("id", score.alias("engagement"))


@query(
    "prj2_post_engagement",
    f"WITH {views.POSTS_SQL} SELECT id, score + num_comments AS engagement FROM posts",
)
def prj2(spark, sf):
    score = scalars.post_engagement(F.col("score"), F.col("num_comments"))
    return views.posts(spark, sf).select("id", score.alias("engagement"))


TOPIC_SCORE_SQL = "reply_count + CAST(floor(views / 10) AS BIGINT)"


@query(
    "prj3_topic_engagement",
    f"WITH {views.TOPICS_SQL} SELECT category, id, {TOPIC_SCORE_SQL} AS engagement FROM topics",
)
def prj3(spark, sf):
    score = scalars.topic_engagement(F.col("reply_count"), F.col("views"))
    return views.topics(spark, sf).select("category", "id", score.alias("engagement"))


@query(
    "prj4_urls",
    f"""SELECT doc_id, 'https://reddit.com/' || source || '/' || doc_id AS post_url,
    '{views.BASE_URL}/t/' || source || '/' || doc_id AS topic_url FROM documents""",
)
def prj4(spark, sf):
    key = F.col("doc_id").cast("string")
    permalink = F.concat(F.lit("/"), F.col("source"), F.lit("/"), key)
    return views.table(spark, sf, "documents").select(
        "doc_id",
        scalars.post_url(permalink).alias("post_url"),
        scalars.topic_url(views.BASE_URL, F.col("source"), key).alias("topic_url"),
    )


@query(
    "prj5_defaults",
    """SELECT doc_id, coalesce(quality, 0) AS quality,
    CASE WHEN toxic IS NULL THEN '[deleted]' ELSE source END AS post_author,
    CASE WHEN toxic IS NULL THEN 'unknown' ELSE source END AS topic_author
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def prj5(spark, sf):
    joined = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id", "left")
    author = F.when(F.col("toxic").isNotNull(), F.col("source"))
    return joined.select(
        "doc_id",
        scalars.nested_or(F.col("quality"), 0).alias("quality"),
        scalars.post_author(author).alias("post_author"),
        scalars.topic_author(author).alias("topic_author"),
    )


def by_reactions(spark, sf):
    return select.ranked(views.open_issues(spark, sf), "reactions", 100, "id")


def by_comments(spark, sf):
    return select.ranked(views.open_issues(spark, sf), "comments", 100, "id")


@query(
    "top1_by_reactions",
    f"{OPEN} SELECT id, reactions FROM open_issues ORDER BY reactions DESC, id LIMIT 100",
)
def top1(spark, sf):
    return select.top(views.open_issues(spark, sf).select("id", "reactions"), "reactions", 100, "id")


@query(
    "top2_by_comments",
    f"{OPEN} SELECT id, comments FROM open_issues ORDER BY comments DESC, id LIMIT 100",
)
def top2(spark, sf):
    return select.top(views.open_issues(spark, sf).select("id", "comments"), "comments", 100, "id")


MERGED_SQL = f"""{OPEN},
a AS (SELECT *, 0 AS list_no, row_number() OVER (ORDER BY reactions DESC, id) AS place FROM open_issues
      QUALIFY place <= 100),
b AS (SELECT *, 1 AS list_no, row_number() OVER (ORDER BY comments DESC, id) AS place FROM open_issues
      QUALIFY place <= 100),
both_lists AS (SELECT * FROM a UNION ALL SELECT * FROM b),
merged AS (SELECT id, min(reactions) AS reactions, min(comments) AS comments,
                  min(list_no * 1000 + place) AS first_place FROM both_lists GROUP BY id)"""


@query("set1_merge_candidates", f"{MERGED_SQL} SELECT id, reactions, comments FROM merged")
def set1(spark, sf):
    merged = select.merge_candidates([by_reactions(spark, sf), by_comments(spark, sf)], "id")
    return merged.select("id", "reactions", "comments")


@query(
    "set1_duplicate_texts",
    """SELECT min(doc_id) AS first_position, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source
    FROM documents GROUP BY text""",
)
def set1_texts(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "source", "text")
    return select.keep_last_value(docs, "text", "doc_id").select("first_position", "doc_id", "source")


@query(
    "set2_concatenate",
    f"""WITH {views.POSTS_SQL}, {views.TOPICS_SQL}
    SELECT CAST(id AS VARCHAR) AS id, score, num_comments, NULL AS views, NULL AS reply_count FROM posts
    UNION ALL SELECT CAST(id AS VARCHAR), NULL, NULL, views, reply_count FROM topics""",
)
def set2(spark, sf):
    posts = views.posts(spark, sf).select(F.col("id").cast("string").alias("id"), "score", "num_comments")
    topics = views.topics(spark, sf).select(F.col("id").cast("string").alias("id"), "views", "reply_count")
    return select.concatenate([posts, topics])


@query(
    "top3_issues",
    f"""{MERGED_SQL} SELECT id, reactions + comments AS engagement FROM merged
    ORDER BY engagement DESC, first_place LIMIT 100""",
)
def top3(spark, sf):
    merged = select.merge_candidates([by_reactions(spark, sf), by_comments(spark, sf)], "id")
    score = scalars.issue_engagement(F.col("reactions"), F.col("comments"))
    best = select.top(merged.withColumn("engagement", score), "engagement", 100, "first_place")
    return best.select("id", "engagement")


@query(
    "top4_posts",
    f"""WITH {views.POSTS_SQL}, best AS (
      SELECT id, score + num_comments AS engagement FROM posts ORDER BY engagement DESC, id LIMIT 50)
    SELECT id, engagement, md5(text) AS digest FROM best JOIN documents ON id = doc_id""",
)
def top4(spark, sf):
    score = scalars.post_engagement(F.col("score"), F.col("num_comments"))
    posts = views.posts(spark, sf).select(F.col("id").alias("doc_id"), score.alias("engagement"))
    winners = select.top(posts, "engagement", 50, "doc_id")
    wide = views.table(spark, sf, "documents").select("doc_id", "text")
    best = select.fetch(wide, winners, "doc_id")
    return best.select(F.col("doc_id").alias("id"), "engagement", F.md5("text").alias("digest"))


@query(
    "top5_topics_per_category",
    f"""WITH {views.TOPICS_SQL}, scored AS (SELECT category, id, {TOPIC_SCORE_SQL} AS engagement FROM topics)
    SELECT category, id, engagement,
           row_number() OVER (PARTITION BY category ORDER BY engagement DESC, id) AS place
    FROM scored QUALIFY place <= 50""",
)
def top5(spark, sf):
    best = select.top_per_group(prj3(spark, sf), "category", "engagement", 50, "id")
    return best.withColumn("place", F.col("place").cast("bigint"))


@query(
    "snk1_append_threads",
    "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, text",
)
def snk1(spark, sf):
    """The same documents arrive twice; each text of a source is stored once."""
    out = fresh_dir(spark, "threads")
    docs = views.table(spark, sf, "documents").select(
        "source", "doc_id", F.sha2("text", 256).alias("digest")
    )
    append_new(docs, out, ["source", "digest"], "doc_id")
    append_new(docs, out, ["source", "digest"], "doc_id")
    return stored(spark, out).select("source", "doc_id")


@query(
    "snk4_ledger",
    "SELECT d.source, CAST(doc_id AS VARCHAR) AS item_id FROM documents d JOIN labels USING (doc_id)",
)
def snk4(spark, sf):
    """The ledger read off what was stored."""
    out = fresh_dir(spark, "ledger")
    docs = views.table(spark, sf, "documents").select("source", "doc_id")
    labelled = docs.join(views.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    append_new(
        labelled.select("source", F.col("doc_id").cast("string").alias("thread_id")),
        out, ["source", "thread_id"], "thread_id",
    )
    return ledger.ledger_of(stored(spark, out))


@query(
    "snk5_resume",
    f"""WITH {views.ANALYSED_SQL}
    SELECT item_id, kind FROM batched WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def snk5(spark, sf):
    """Items of labelled documents have stored results; the rest is pending."""
    out = fresh_dir(spark, "done")
    items = views.exploded(spark, sf)
    done = items.join(views.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    append_new(done.select("source", "item_id"), out, ["item_id"], "item_id")
    return ledger.pending(items.select("item_id", "kind"), stored(spark, out))

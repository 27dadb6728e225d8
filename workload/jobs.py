"""Whole jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import classify
from voxmill.plans import collect, feedback
from voxmill.session import fresh_dir
from voxmill.sinks.tables import stored
from workload import views
from workload.categories import LEXICON_ANSWERS_SQL
from workload.registry import query
from workload.reports import SCORE_SQL

# 180 days after this moment, half of the given documents are recent.
LATER = views.FIRST_SECOND + 180 * 86_400


def _as_of(spark, sf, table: str, key: str):
    """The moment at which the upper half of the table is recent."""
    middle = views.table(spark, sf, table).agg(F.floor(F.max(key) / 2).cast("bigint").alias("m"))
    return F.timestamp_seconds(F.lit(LATER) + middle.select("m").scalar() * 60)


def _stored_twice(spark, collect_again, found_id: str):
    """Collected and stored twice, the second time nothing is new; threads with all their
    bodies, then the quarantine, where ``found_id`` picks the id out of the kept text."""
    path = fresh_dir(spark, "collected")
    for run in ("first", "second"):
        collect.store(collect_again(collect.ledger_at(spark, path)), path, run)
    bodies = F.array_join(F.transform("comments", lambda c: c["body"]), "\n")
    threads = stored(spark, path).select("thread_id", F.lit(None).cast("string").alias("problem"), bodies.alias("text"))
    bad = stored(spark, f"{path}_quarantine").select(
        F.regexp_extract("raw", found_id, 1).alias("thread_id"), "problem", F.md5("raw").alias("digest")
    )
    bad = bad.groupBy("thread_id", "problem").agg(F.count_distinct("digest").cast("string").alias("text"))
    return threads.unionByName(bad)


@query(
    "job_collect_issues",
    """WITH half AS (SELECT max(doc_id) // 2 AS m FROM documents),
    open_issues AS (
      SELECT doc_id, n_chars // 100 AS reactions, len(string_split(text, chr(10))) - 1 AS comments
      FROM documents, half WHERE doc_id >= m AND doc_id % 11 <> 0 AND doc_id % 13 <> 0),
    a AS (SELECT *, row_number() OVER (ORDER BY doc_id * 37 % 1009 DESC, doc_id) AS place FROM open_issues QUALIFY place <= 100),
    b AS (SELECT *, 1000 + row_number() OVER (ORDER BY comments DESC, doc_id) AS place FROM open_issues QUALIFY place <= 1100),
    merged AS (SELECT doc_id, min(place) AS place, min(reactions + comments) AS engagement
               FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1),
    best AS (SELECT doc_id FROM merged ORDER BY engagement DESC, place LIMIT 100),
    new AS (SELECT doc_id FROM best WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT CAST(doc_id AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS problem,
      CASE WHEN doc_id % 3 <> 0 THEN text ELSE regexp_replace(text, '\\A[^\n]*', '') END AS text
    FROM new JOIN documents USING (doc_id) WHERE doc_id % 10 <> 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no author', '1' FROM new WHERE doc_id % 10 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unreadable', '2' FROM documents WHERE doc_id % 11 = 0""",
)
def job_collect_issues(spark, sf):
    landed = views.landed_twice(views.issue_payloads(spark, sf), "total_count")
    as_of = _as_of(spark, sf, "documents", "doc_id")
    before = views.table(spark, sf, "labels").select(
        F.lit("GitHub").alias("source"), F.col("doc_id").cast("string").alias("item_id")
    )

    def again(ledger):
        ledger = before if ledger is None else before.unionByName(ledger)
        return collect.collect_issues(landed, as_of, ledger, version="landing")

    return _stored_twice(spark, again, '^\\{+"id":(\\d+),')


@query(
    "job_collect_posts",
    """WITH half AS (SELECT max(doc_id) // 2 AS m FROM documents),
    posts AS (SELECT doc_id, 'p' || doc_id AS id, n_chars AS score, len(string_split(text, chr(10))) AS n FROM documents),
    a AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM posts QUALIFY place <= 100),
    b AS (SELECT *, 1000 + row_number() OVER (ORDER BY n DESC, id) AS place FROM posts QUALIFY place <= 1100),
    merged AS (SELECT doc_id, min(id) AS id, min(place) AS place, min(score + n) AS engagement
               FROM (SELECT * FROM a UNION ALL SELECT * FROM b), half WHERE doc_id >= m GROUP BY 1),
    best AS (SELECT doc_id, id FROM merged ORDER BY engagement DESC, place LIMIT 50),
    kept AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x, i: i = 1 OR (i % 4 <> 1 AND x <> '')) AS lines
             FROM best JOIN documents USING (doc_id))
    SELECT id AS thread_id, CAST(NULL AS VARCHAR) AS problem,
      array_to_string(CASE WHEN doc_id % 3 <> 0 THEN lines ELSE list_prepend('', lines[2:]) END, chr(10)) AS text FROM kept""",
)
def job_collect_posts(spark, sf):
    landed = views.landed_twice(views.post_payloads(spark, sf), "score")
    as_of = _as_of(spark, sf, "documents", "doc_id")

    def again(ledger):
        return collect.collect_posts(landed, as_of, ledger, version="landing")

    return _stored_twice(spark, again, '"id":"(p\\d+)"')


@query(
    "job_collect_topics",
    """WITH half AS (SELECT max(page_id) // 2 AS m FROM pages),
    topics AS (SELECT page_id, html, page_id % 9 AS category,
                 CASE WHEN page_id % 4 <> 0 THEN page_id * 2 ELSE 0 END + length(html) // 10 AS engagement
               FROM pages, half WHERE page_id >= m AND page_id % 9 IN (5, 7))
    SELECT CAST(page_id AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS problem,
      regexp_replace(html, '\\A\\s+|\\s+\\z', '', 'g') AS text FROM topics
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY engagement DESC, page_id) <= 50""",
)
def job_collect_topics(spark, sf):
    landed = views.landed_twice(views.topic_payloads(spark, sf), "views")
    as_of = _as_of(spark, sf, "pages", "page_id")

    def again(ledger):
        return collect.collect_topics(landed, as_of, views.BASE_URL, ledger, version="landing")

    return _stored_twice(spark, again, '"id":(\\d+)')


@query(
    "job_feedback",
    f"""{LEXICON_ANSWERS_SQL}, items AS (
      SELECT category, priority FROM lexicon_answers JOIN batched USING (item_id, kind) WHERE kind = 'pain_points')
    SELECT category, count(*) AS frequency, CAST(sum({SCORE_SQL}) AS BIGINT) AS total_priority FROM items GROUP BY 1""",
)
def job_feedback(spark, sf):
    """Categorised twice, the second time nothing is pending; the matrix comes from the
    stored reports."""
    out = fresh_dir(spark, "feedback")
    analysed = views.analysed(spark, sf)

    def lexicon(items):
        answers = classify.classify_by_lexicon(items, views.LEXICON)
        return answers.withColumn("status", F.lit(classify.ANSWERED))

    for _ in range(2):
        answers = feedback.categorise(analysed, f"{out}/answers", lexicon, "doc_id")
    feedback.write_reports(spark, answers, f"{out}/reports")
    matrix = spark.read.parquet(f"{out}/reports/priority_matrix")
    return matrix.select("category", "frequency", "total_priority")

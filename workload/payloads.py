"""Raw payloads to threads, landed files, dates, JSON and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill import schemas
from voxmill.functions import scalars
from voxmill.functions.text import clean_text
from voxmill.operators.clean import clean_threads
from voxmill.plans.clean import clean_files
from voxmill.session import fresh_dir
from voxmill.sinks.tables import stored
from voxmill.sources import payloads, threads
from voxmill.streaming import collect as streaming
from workload import views
from workload.registry import query
from workload.texts import BODIES_SQL, chain_sql

ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"
START = f"(TIMESTAMP '1970-01-01' + to_seconds({views.FIRST_SECOND}))"

LINES_SQL = """split AS (SELECT *, string_split(text, chr(10)) AS parts FROM documents),
flat AS (SELECT * EXCLUDE (parts, text), parts[1] AS first, unnest(parts) AS line,
                generate_subscripts(parts, 1) - 1 AS i FROM split)"""


def _flat(df, *extra: str):
    """Threads one comment per row, times as text."""
    opened = df.select(
        "thread_id", "url", "title", "author", *extra,
        scalars.iso_text(F.col("created_at")).alias("created"),
        F.posexplode("comments").alias("pos", "c"),
    )
    return opened.select(
        "thread_id", "url", "title", "author", "created", *extra,
        F.col("pos").cast("bigint").alias("pos"),
        "c.comment_id",
        F.col("c.author").alias("comment_author"),
        scalars.iso_text(F.col("c.created_at")).alias("comment_created"),
        "c.body",
    )


@query(
    "src4_issues",
    f"""WITH {LINES_SQL}
    SELECT CAST(doc_id AS VARCHAR) AS thread_id, 'https://e/' || source || '/' || doc_id AS url, first AS title,
      source AS author, strftime({START} + to_seconds(doc_id * 60), {ISO}) AS created,
      doc_id + 1 AS issue_number, lang || ',' || source AS label_names, i AS pos,
      CASE i WHEN 0 THEN '0' ELSE CAST(doc_id * 1000 + i - 1 AS VARCHAR) END AS comment_id,
      CASE i WHEN 0 THEN source ELSE lang END AS comment_author,
      strftime({START} + to_seconds(doc_id * 60 + i), {ISO}) AS comment_created,
      CASE WHEN i > 0 THEN line WHEN doc_id % 3 <> 0 THEN first ELSE '' END AS body
    FROM flat WHERE doc_id % 10 <> 0 AND doc_id % 11 <> 0""",
)
def src4(spark, sf):
    raw = payloads.parse_payloads(views.issue_payloads(spark, sf), "payload", schemas.ISSUE_PAYLOAD)
    good = payloads.sound(payloads.normalise_issues(raw))
    return _flat(good.withColumn("label_names", F.array_join("labels", ",")), "issue_number", "label_names")


@query(
    "arr5_label_names",
    """SELECT CAST(doc_id AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS problem, lang || ',' || source AS label_names
    FROM documents
    UNION ALL
    SELECT CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id AS VARCHAR) END,
      CASE WHEN doc_id % 11 = 0 THEN 'unreadable' ELSE 'no author' END,
      CASE WHEN doc_id % 11 <> 0 THEN lang || ',' || source END
    FROM documents WHERE doc_id % 10 = 0 OR doc_id % 11 = 0""",
)
def arr5(spark, sf):
    """Every document as a sound issue, and among them the spoilt ones once more, which the
    threads must not have; they come with their problem."""
    spoilt = (F.pmod("doc_id", F.lit(10)) == 0) | (F.pmod("doc_id", F.lit(11)) == 0)
    landed = views.issue_payloads(spark, sf, sound=True).union(views.issue_payloads(spark, sf).where(spoilt))
    raw = payloads.parse_payloads(landed, "payload", schemas.ISSUE_PAYLOAD)
    normalised = payloads.normalise_issues(raw)
    names = F.array_join("labels", ",").alias("label_names")
    good = payloads.sound(normalised).select("thread_id", F.lit(None).cast("string").alias("problem"), names)
    return good.union(payloads.quarantine(normalised).select("thread_id", "problem", names))


@query(
    "src5_posts",
    f"""WITH {LINES_SQL}, kept AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM flat
      WHERE i = 0 OR (i - 1) % 4 <> 3)
    SELECT 'p' || doc_id AS thread_id, 'https://reddit.com/r/' || source || '/' || doc_id AS url, first AS title,
      CASE WHEN doc_id % 5 <> 0 THEN source ELSE '[deleted]' END AS author,
      strftime({START} + to_seconds(doc_id * 60), {ISO}) AS created, n_chars AS score, pos,
      CASE i WHEN 0 THEN 'p' || doc_id ELSE 'c' || (i - 1) END AS comment_id,
      CASE WHEN i = 0 AND doc_id % 5 <> 0 THEN source WHEN i > 0 AND (i - 1) % 2 = 0 THEN lang
           ELSE '[deleted]' END AS comment_author,
      strftime({START} + to_seconds(doc_id * 60 + i), {ISO}) AS comment_created,
      CASE WHEN i > 0 THEN line WHEN doc_id % 3 <> 0 THEN first ELSE '' END AS body
    FROM kept""",
)
def src5(spark, sf):
    raw = payloads.parse_payloads(views.post_payloads(spark, sf), "payload", schemas.POST_PAYLOAD)
    return _flat(payloads.sound(payloads.normalise_posts(raw)), "score")


@query(
    "src6_topics",
    f"""SELECT CAST(page_id AS VARCHAR) AS thread_id, '{views.BASE_URL}/t/t-' || page_id || '/' || page_id AS url,
      url AS title, CASE WHEN page_id % 3 <> 0 THEN 'last' ELSE 'unknown' END AS author,
      strftime({START} + to_seconds(page_id * 60), {ISO}) AS created,
      CASE WHEN page_id % 4 <> 0 THEN page_id * 2 ELSE 0 END AS reply_count,
      CAST(length(html) AS BIGINT) AS views, CAST(0 AS BIGINT) AS pos, CAST(page_id AS VARCHAR) AS comment_id,
      CASE WHEN page_id % 5 <> 0 THEN 'ann' ELSE 'unknown' END AS comment_author,
      strftime({START} + to_seconds(page_id * 60), {ISO}) AS comment_created,
      regexp_replace(html, '\\A\\s+|\\s+\\z', '', 'g') AS body
    FROM pages""",
)
def src6(spark, sf):
    raw = payloads.parse_payloads(views.topic_payloads(spark, sf), "payload", schemas.TOPIC_PAYLOAD)
    good = payloads.sound(payloads.normalise_topics(raw, views.BASE_URL))
    return _flat(good, "reply_count", "views")


@query(
    "src9_quarantine",
    """SELECT CASE WHEN doc_id % 11 = 0 THEN 'unreadable' ELSE 'no author' END AS problem, count(*) AS n
    FROM documents WHERE doc_id % 10 = 0 OR doc_id % 11 = 0 GROUP BY 1""",
)
def src9(spark, sf):
    raw = payloads.parse_payloads(views.issue_payloads(spark, sf), "payload", schemas.ISSUE_PAYLOAD)
    bad = payloads.quarantine(payloads.normalise_issues(raw))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _land_threads(spark, sf):
    """Nested threads landed as JSON lines, with a field no schema knows."""
    out = fresh_dir(spark, "landed")
    landed = views.threads(spark, sf).drop("file_name").withColumn("mood", F.lit("calm"))
    landed.write.json(out)
    return out


@query(
    "src1_read_threads",
    f"""WITH {BODIES_SQL} SELECT CAST(doc_id AS VARCHAR) AS thread_id, 'GitHub' AS source,
    '{{"mood":"calm"}}' AS extra, i, body FROM bodies""",
)
def src1(spark, sf):
    read = threads.read_threads(spark, _land_threads(spark, sf), json_lines=True)
    flat = read.select("thread_id", "source", "extra", F.posexplode("comments").alias("i", "c"))
    return flat.select("thread_id", "source", "extra", F.col("i").cast("bigint").alias("i"), "c.body")


@query(
    "src2_find_inputs",
    f"""WITH {BODIES_SQL} SELECT CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS folder,
    CAST(doc_id AS VARCHAR) AS thread_id, count(*) AS comments, count(body) AS bodies,
    CAST(sum(length(body)) AS BIGINT) AS chars FROM bodies GROUP BY 1, 2""",
)
def src2(spark, sf):
    """Threads in two folders; their cleaned copies lie beside them and are not read again."""
    out = fresh_dir(spark, "landed")
    halves = F.pmod(F.col("thread_id").cast("bigint"), F.lit(2))
    for half, folder in enumerate("ab"):
        views.threads(spark, sf).where(halves == half).drop("file_name").write.json(f"{out}/{folder}")
    clean_files(spark, out, f"{out}/copies", views.PRODUCT, json_lines=True)
    read = threads.read_threads(spark, out, json_lines=True)
    lengths = F.transform(F.filter("comments", lambda c: c["body"].isNotNull()), lambda c: F.length(c["body"]))
    return read.select(
        F.substring_index("file_name", "/", 1).alias("folder"),
        "thread_id",
        F.size("comments").cast("bigint").alias("comments"),
        F.size(lengths).cast("bigint").alias("bodies"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda n, m: n + m).alias("chars"),
    )


@query(
    "src3_guards",
    f"""WITH {BODIES_SQL}, texts AS (SELECT doc_id, i, coalesce(body, '') AS body FROM bodies),
    {chain_sql("texts", "doc_id, i", "body")}
    SELECT CAST(doc_id AS VARCHAR) AS thread_id, i, cleaned FROM cleaned
    UNION ALL SELECT 'odd' || doc_id, NULL, NULL FROM documents WHERE doc_id % 4 <> 0""",
)
def src3(spark, sf):
    """Between sound records, odd ones keep their row: no comments, comments no array, null."""
    out = fresh_dir(spark, "odd")
    shape = F.pmod(F.col("thread_id").cast("bigint"), F.lit(4))
    good = F.to_json(F.struct("source", "thread_id", "comments"))
    head = F.concat(F.lit('{"thread_id":"odd'), "thread_id", F.lit('"'))
    odd = (
        F.when(shape == 1, F.concat(head, F.lit("}")))
        .when(shape == 2, F.concat(head, F.lit(',"comments":"none"}')))
        .when(shape == 3, F.concat(head, F.lit(',"comments":null}')))
    )
    lines = views.threads(spark, sf).select(F.explode(F.array(good, odd)).alias("value")).where("value IS NOT NULL")
    lines.write.option("compression", "none").text(out)
    raw = spark.read.text(out).select(F.try_parse_json("value").alias("record"))
    read = clean_threads(threads.as_threads(raw), views.PRODUCT)
    flat = read.select("thread_id", F.posexplode_outer("comments").alias("i", "c"))
    return flat.select("thread_id", F.col("i").cast("bigint").alias("i"), F.col("c.cleaned_body").alias("cleaned"))


@query(
    "src7_analysed_threads",
    f"""WITH {views.ANALYSED_SQL} SELECT thread_id, source, sentiment, priority, user_type,
    array_to_string(pain_points, chr(10)) AS pain_points, array_to_string(feature_requests, chr(10)) AS feature_requests
    FROM analysed""",
)
def src7(spark, sf):
    out = fresh_dir(spark, "analysed")
    views.analysed(spark, sf).drop("doc_id").write.json(out)
    read = threads.read_analysed(spark, out, json_lines=True)
    texts = [F.array_join(k, "\n").alias(k) for k in ("pain_points", "feature_requests")]
    return read.select("thread_id", "source", "sentiment", "priority", "user_type", *texts)


# -- JSON and dates ---------------------------------------------------------


@query(
    "jsn2_serialise",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"'
    || replace(props, '"', '\\"') || '"}' AS document FROM events""",
)
def jsn2(spark, sf):
    events = views.table(spark, sf, "events")
    return events.select("event_id", scalars.to_document("event_id", "event_type", "props").alias("document"))


@query(
    "jsn3_nested_default",
    """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(0 AS BIGINT) AS missing
    FROM events""",
)
def jsn3(spark, sf):
    props = F.from_json("props", "k bigint, inner struct<deep: bigint>")
    return views.table(spark, sf, "events").select(
        "event_id",
        scalars.nested_or(props["k"], 0).alias("k"),
        scalars.nested_or(props["inner"]["deep"], 0).cast("bigint").alias("missing"),
    )


def _utc_text(moment):
    """A zoneless timestamp as ISO text with ``Z``."""
    return F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


@query(
    "dat1_parse_iso",
    "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events",
)
def dat1(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", F.unix_seconds(scalars.parse_iso(_utc_text(F.col("ts")))).alias("seconds")
    )


@query(
    "dat2_epoch",
    "SELECT event_id, strftime(make_timestamp(event_id * 60000000), '%Y-%m-%d %H:%M:%S') AS moment FROM events",
)
def dat2(spark, sf):
    moment = scalars.from_epoch(F.col("event_id") * 60)
    return views.table(spark, sf, "events").select(
        "event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment")
    )


@query(
    "dat3_cutoff",
    f"""SELECT updated_at >= TIMESTAMP '{views.CUTOFF}' AS recent, count(*) AS n
    FROM (SELECT o_orderdate AS updated_at FROM orders) GROUP BY 1""",
)
def dat3(spark, sf):
    recent = F.col("o_orderdate") >= scalars.cutoff(views.as_of())
    return views.table(spark, sf, "orders").groupBy(recent.alias("recent")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dat4_iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS text FROM events""",
)
def dat4(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", scalars.iso_text(scalars.parse_iso(_utc_text(F.col("ts")))).alias("text")
    )


# -- stream -----------------------------------------------------------------


@query(
    "str1_collect_stream",
    f"""WITH {views.DECORATED_SQL}, firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
    texts AS (SELECT doc_id, body FROM decorated JOIN firsts USING (doc_id)),
    {chain_sql("texts", "doc_id", "body")} SELECT doc_id, cleaned FROM cleaned""",
)
def str1(spark, sf):
    """Documents as a feed, cleaned on the way, each text once; the second run, over the
    same files from a new checkpoint, must add nothing."""
    sink = fresh_dir(spark, "sink")
    snippets = F.array(*map(F.lit, views.SNIPPETS))
    which = (F.pmod("doc_id", F.lit(12)) + 1).cast("int")
    body = F.concat(F.element_at(snippets, which), "text")
    schema = views.table(spark, sf, "documents").schema

    def prepare(new):
        cleaned = clean_text(body, product=views.PRODUCT)
        return new.withColumn("cleaned", cleaned).drop("text", "lang", "n_chars")

    for _ in range(2):
        # A pattern, for a table is one file or a folder of parts, and a stream takes no plain file.
        feed = streaming.landed(spark, f"{sf}/documents.parque[t]", schema, "parquet")
        keyed = feed.withColumn("digest", F.sha2("text", 256))
        run = streaming.collect(
            keyed, sink, fresh_dir(spark, "progress"), ["digest"], "doc_id", prepare=prepare
        )
        run.awaitTermination()
    return stored(spark, sink).select("doc_id", "cleaned")

"""The given tables seen as feedback data. Each view has an SQL twin of the same name.

No given table holds feedback, so these views map one onto the other, row by row and over
whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions.scalars import estimate_tokens
from voxmill.operators.items import batched_items, explode_items, prompts
from voxmill.operators.select import open_only, recent, without_pull_requests

AS_OF = "2001-08-01 00:00:00"
CUTOFF = "2001-02-02 00:00:00"
BASE_URL = "https://forum.example"
PRODUCT = "Acme Notes"
FIRST_SECOND = 1_700_000_000

# Constructs the given texts lack, put before each text by ``doc_id % 12``.
SNIPPETS = (
    "",
    "### Operating system\nLinux\n### Logs\n_No response_\n",
    "Logseq is better\n",
    "![shot](http://e/x.png) ",
    "```js\nlet a = 1;\n\nb\n``` ",
    "run `npm i` and [the docs](http://e/d) ",
    "**bold** and *it* and __u__ and _v_ foo_bar_baz\n",
    "> quoted\n  > deeper\nreply\n",
    "On Mon, Jan 1, Ann wrote:\nhi\n",
    "sig ---  \n\nafter\n",
    "a\n\n\n\nb    c  d\n",
    "[[n](u)](w) ```open `x` **Logs**\n  ",
)

# Words that occur in the given texts, in the form of a lexicon.
LEXICON = {
    vocab.PAIN_POINTS: {
        "Sync & Data Management": ("the", "la", "der"),
        "Editor & Text Input": ("and", "le", "und"),
        "Mobile Experience": ("of", "de", "die", "que"),
        "Performance & Speed": ("to", "el", "in"),
        "Security & Privacy": ("stupid", "worthless"),
    },
    vocab.FEATURE_REQUESTS: {
        "Editor Enhancements": ("the", "et", "das"),
        "Mobile Features": ("that", "les", "ist"),
        "Sync Improvements": ("with", "en", "por"),
        "Customization Options": ("be", "it", "is"),
    },
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def as_of() -> Column:
    return F.to_timestamp_ntz(F.lit(AS_OF))


# -- categorised items ------------------------------------------------------

ITEMS_SQL = """items AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE l_linestatus WHEN 'O' THEN 'pain_points' ELSE 'feature_requests' END AS kind,
         p_brand AS category, p_name AS text,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unspecified' END AS priority,
         o_orderstatus AS sentiment, p_type AS source, c_mktsegment AS user_type,
         CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Medium' ELSE 'Low' END AS confidence,
         l_orderkey * 10 + l_linenumber AS position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as categorised items. Small sides are joined to each other first, so
    the line items are joined once per key and never to a wide table."""
    priority = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
        .when(F.col("o_orderpriority") == "5-LOW", "low")
        .otherwise("unspecified")
    )
    confidence = (
        F.when(F.col("l_returnflag") == "A", "High")
        .when(F.col("l_returnflag") == "N", "Medium")
        .otherwise("Low")
    )
    orders = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            priority.alias("priority"),
            F.col("o_orderstatus").alias("sentiment"),
            F.col("c_mktsegment").alias("user_type"),
        )
    )
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("source"),
        F.col("p_name").alias("text"),
    )
    lines = table(spark, sf, "lineitem")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(part, lines["l_partkey"] == part["p_partkey"])
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.when(F.col("l_linestatus") == "O", vocab.PAIN_POINTS)
            .otherwise(vocab.FEATURE_REQUESTS)
            .alias("kind"),
            "category",
            "text",
            "priority",
            "sentiment",
            "source",
            "user_type",
            confidence.alias("confidence"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        )
    )


# -- candidates -------------------------------------------------------------

ISSUES_SQL = """lines AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
issues AS (
  SELECT o_orderkey AS id, o_orderstatus AS state,
         CASE o_orderpriority WHEN '5-LOW' THEN 'pr' END AS pull_request,
         o_orderdate AS updated_at, CAST(floor(o_totalprice / 1000) AS BIGINT) AS reactions,
         CAST(coalesce(n, 0) AS BIGINT) AS comments
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)"""


def issues(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf, "orders")
    return orders.join(counted, orders["o_orderkey"] == counted["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("state"),
        F.when(F.col("o_orderpriority") == "5-LOW", "pr").alias("pull_request"),
        F.col("o_orderdate").alias("updated_at"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("reactions"),
        F.coalesce("n", F.lit(0)).alias("comments"),
    )


POSTS_SQL = """posts AS (
  SELECT doc_id AS id, source, n_chars AS score,
         CAST(len(string_split(text, chr(10))) AS BIGINT) AS num_comments
  FROM documents)"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("n_chars").alias("score"),
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("num_comments"),
    )


TOPICS_SQL = """topics AS (
  SELECT event_type AS category, user_id AS id, count(*) AS reply_count,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS views
  FROM events GROUP BY 1, 2)"""


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("category"), F.col("user_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("reply_count"),
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("views"),
        )
    )


# -- texts ------------------------------------------------------------------

DECORATED_SQL = f"""decorated AS (
  SELECT doc_id, source, {sql_list(SNIPPETS)}[doc_id % 12 + 1] || text AS body FROM documents)"""


def decorated(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with a construct in front, so that every cleaning step has work."""
    snippets = F.array(*map(F.lit, SNIPPETS))
    which = (F.pmod("doc_id", F.lit(12)) + 1).cast("int")
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.concat(F.element_at(snippets, which), "text").alias("body")
    )


# -- analysed threads and their items ---------------------------------------

ANALYSED_SQL = """analysed AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS thread_id, source,
         CASE lang WHEN 'en' THEN 'positive' WHEN 'fr' THEN 'negative' ELSE 'neutral' END AS sentiment,
         ['high', 'medium', 'low', 'none'][doc_id % 4 + 1] AS priority, lang AS user_type,
         CASE WHEN doc_id % 7 <> 0 THEN list_filter(string_split(text, chr(10)), lambda x, i: i % 3 <> 0)
              ELSE string_split(text, chr(10)) END AS pain_points,
         CASE WHEN doc_id % 7 <> 0
              THEN list_filter(string_split(text, chr(10)), lambda x, i: i % 3 = 0) END AS feature_requests
  FROM documents),
exploded AS (
  SELECT doc_id, thread_id, source, sentiment, priority, user_type, 'pain_points' AS kind,
         unnest(pain_points) AS text, generate_subscripts(pain_points, 1) - 1 AS list_pos FROM analysed
  UNION ALL
  SELECT doc_id, thread_id, source, sentiment, priority, user_type, 'feature_requests',
         unnest(feature_requests), generate_subscripts(feature_requests, 1) - 1 FROM analysed),
batched AS (
  SELECT *, source || ':' || thread_id || ':' || kind || ':' || list_pos AS item_id,
         row_number() OVER (PARTITION BY kind ORDER BY doc_id, list_pos) - 1 AS item_index,
         count(*) OVER (PARTITION BY kind) AS total FROM exploded),
numbered AS (
  SELECT *, item_index // 25 + 1 AS batch_num, item_index % 25 AS pos_in_batch,
         (total + 24) // 25 AS total_batches FROM batched)"""


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as analysed threads: lines are pain points, every third is a request; every
    seventh thread has no list of requests, all its lines are pain points."""
    lines = F.split("text", "\n", -1)
    priorities = F.array(*map(F.lit, ("high", "medium", "low", "none")))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("thread_id"),
        "source",
        F.when(F.col("lang") == "en", "positive")
        .when(F.col("lang") == "fr", "negative")
        .otherwise("neutral")
        .alias("sentiment"),
        F.element_at(priorities, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("priority"),
        F.col("lang").alias("user_type"),
        F.when(
            F.pmod("doc_id", F.lit(7)) != 0,
            F.filter(lines, lambda _, i: F.pmod(i + 1, F.lit(3)) != 0),
        )
        .otherwise(lines)
        .alias("pain_points"),
        F.when(
            F.pmod("doc_id", F.lit(7)) != 0,
            F.filter(lines, lambda _, i: F.pmod(i + 1, F.lit(3)) == 0),
        ).alias("feature_requests"),
    )


def exploded(spark: SparkSession, sf: str) -> DataFrame:
    return explode_items(analysed(spark, sf), "doc_id")


def batched(spark: SparkSession, sf: str) -> DataFrame:
    return batched_items(analysed(spark, sf), "doc_id")


# -- landed model replies ---------------------------------------------------

REPLY_CATEGORY_SQL = (
    "CASE kind WHEN 'pain_points' THEN "
    + sql_list((*vocab.PAIN_POINT_CATEGORIES, "Off list"))
    + "[length(text) % 16 + 1] ELSE "
    + sql_list((*vocab.FEATURE_REQUEST_CATEGORIES, "Off list"))
    + "[length(text) % 16 + 1] END"
)
REPLY_CONFIDENCE_SQL = "['High', 'Medium', 'Low', 'Sure'][length(text) % 4 + 1]"


def _pick(options, text: Column) -> Column:
    at = F.pmod(F.length(text), F.lit(len(options))) + 1
    return F.element_at(F.array(*map(F.lit, options)), at)


def reply_category(kind: Column, text: Column) -> Column:
    return F.when(
        kind == vocab.PAIN_POINTS, _pick((*vocab.PAIN_POINT_CATEGORIES, "Off list"), text)
    ).otherwise(_pick((*vocab.FEATURE_REQUEST_CATEGORIES, "Off list"), text))


def reply_confidence(text: Column) -> Column:
    return _pick((*vocab.CONFIDENCE_LEVELS, "Sure"), text)


def replies(batches: DataFrame) -> DataFrame:
    """A landed reply per batch. By batch number modulo five it is: no JSON, fenced, one
    answer short, one answer long, or its first answer echoes another text."""
    case = F.pmod("batch_num", F.lit(5))
    echo = F.when((case == 4) & (F.col("pos_in_batch") == 0), F.concat("text", F.lit("?")))
    answer = F.struct(
        "pos_in_batch",
        F.coalesce(echo, "text").alias("text"),
        reply_category(F.col("kind"), F.col("text")).alias("category"),
        reply_confidence(F.col("text")).alias("confidence"),
        F.lit("by length").alias("reasoning"),
    )
    grouped = batches.groupBy("kind", "batch_num").agg(
        F.array_sort(F.collect_list(answer)).alias("answers"),
        F.sum(estimate_tokens(F.col("text"))).alias("prompt_tokens"),
        (F.count(F.lit(1)) * 50).alias("completion_tokens"),
    )
    answers = F.transform(
        "answers",
        lambda a: F.struct(*(a[f].alias(f) for f in ("text", "category", "confidence", "reasoning"))),
    )
    extra = F.array(
        F.struct(
            F.lit("extra").alias("text"),
            F.lit("Other").alias("category"),
            F.lit("Low").alias("confidence"),
            F.lit("none asked").alias("reasoning"),
        )
    )
    shaped = grouped.withColumn(
        "shaped",
        F.when(case == 2, F.slice(answers, F.lit(1), F.size("answers") - 1))
        .when(case == 3, F.concat(answers, extra))
        .otherwise(answers),
    )
    text = F.to_json("shaped")
    reply = (
        F.when(case == 0, F.lit("Sorry, I cannot do that."))
        .when(case == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .otherwise(text)
    )
    return shaped.select(
        "kind", "batch_num", reply.alias("reply"), "prompt_tokens", "completion_tokens"
    )


def batch_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(batched(spark, sf), PRODUCT)


# -- raw payloads -----------------------------------------------------------


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _rest(lines: Column) -> Column:
    return F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))


def _second(offset: Column) -> Column:
    """Seconds since the epoch."""
    return F.lit(FIRST_SECOND) + offset


def iso_z(seconds: Column) -> Column:
    """ISO text in UTC whatever the session's zone."""
    moment = F.timestamp_add("SECOND", seconds, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def issue_payloads(spark: SparkSession, sf: str, sound: bool = False) -> DataFrame:
    """Documents as raw issues: the first line is title and body, each other a comment.

    Every tenth has no author and every eleventh is no valid JSON, but where all are ``sound``."""
    doc = F.col("doc_id")
    text = F.to_json(
        F.struct(
            doc.alias("id"),
            (doc + 1).alias("number"),
            F.concat(F.lit("https://e/"), "source", F.lit("/"), doc.cast("string")).alias("html_url"),
            F.element_at(_lines(), 1).alias("title"),
            F.when(
                F.lit(sound) | (F.pmod(doc, F.lit(10)) != 0), F.struct(F.col("source").alias("login"))
            ).alias("user"),
            F.lit("open").alias("state"),
            F.when(F.pmod(doc, F.lit(13)) == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"),
            F.struct(
                F.floor(F.col("n_chars") / 100).alias("total_count"),
                F.pmod(doc * 37, F.lit(1009)).alias("+1"),
            ).alias("reactions"),
            (F.size(_lines()) - 1).alias("comments"),
            iso_z(_second(doc * 60)).alias("updated_at"),
            F.array(
                F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))
            ).alias("labels"),
            F.when(F.pmod(doc, F.lit(3)) != 0, F.element_at(_lines(), 1)).alias("body"),
            iso_z(_second(doc * 60)).alias("created_at"),
            F.transform(
                _rest(_lines()),
                lambda line, i: F.struct(
                    (doc * 1000 + i).alias("id"),
                    F.struct(F.col("lang").alias("login")).alias("user"),
                    iso_z(_second(doc * 60 + i + 1)).alias("created_at"),
                    line.alias("body"),
                ),
            ).alias("comment_list"),
        )
    )
    broken = F.when(~F.lit(sound) & (F.pmod(doc, F.lit(11)) == 0), F.concat(F.lit("{"), text)).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", broken.alias("payload"))


def post_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw posts; every fifth author and every fourth comment body is gone."""
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("p"), doc.cast("string")).alias("id"),
                F.concat(F.lit("/r/"), "source", F.lit("/"), doc.cast("string")).alias("permalink"),
                F.element_at(_lines(), 1).alias("title"),
                F.when(F.pmod(doc, F.lit(5)) != 0, F.col("source")).alias("author"),
                F.col("n_chars").alias("score"),
                F.size(_lines()).alias("num_comments"),
                _second(doc * 60).cast("double").alias("created_utc"),
                F.when(F.pmod(doc, F.lit(3)) != 0, F.element_at(_lines(), 1)).alias("selftext"),
                F.transform(
                    _rest(_lines()),
                    lambda line, i: F.struct(
                        F.concat(F.lit("c"), i.cast("string")).alias("id"),
                        F.when(F.pmod(i, F.lit(2)) == 0, F.col("lang")).alias("author"),
                        _second(doc * 60 + i + 1).cast("double").alias("created_utc"),
                        F.when(F.pmod(i, F.lit(4)) != 3, line).alias("body"),
                    ),
                ).alias("comment_list"),
            )
        ).alias("payload"),
    )


def topic_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as raw topics with one post, and documents' counts left out for some."""
    page = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id",
        F.to_json(
            F.struct(
                page.alias("id"),
                F.pmod(page, F.lit(9)).alias("category_id"),
                F.concat(F.lit("t-"), page.cast("string")).alias("slug"),
                F.col("url").alias("title"),
                F.when(F.pmod(page, F.lit(3)) != 0, F.lit("last")).alias("last_poster_username"),
                F.when(F.pmod(page, F.lit(4)) != 0, page * 2).alias("reply_count"),
                F.length("html").alias("views"),
                iso_z(_second(page * 60)).alias("created_at"),
                F.struct(
                    F.array(
                        F.struct(
                            page.alias("id"),
                            F.when(F.pmod(page, F.lit(5)) != 0, F.lit("ann")).alias("username"),
                            iso_z(_second(page * 60)).alias("created_at"),
                            F.concat(F.lit("\n "), "html", F.lit(" \t")).alias("cooked"),
                        )
                    ).alias("posts")
                ).alias("post_stream"),
            )
        ).alias("payload"),
    )


def landed_twice(payloads: DataFrame, count: str) -> DataFrame:
    """Each payload (``value``) after an older one, in which ``count`` was nine digits long:
    whoever takes the older one ranks it first."""
    older = F.regexp_replace("payload", f'"{count}":(\\d)', f'"{count}":12345678$1')
    return payloads.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("landing"), older.alias("value")),
                F.struct(F.lit(2).alias("landing"), F.col("payload").alias("value")),
            )
        )
    )


# -- nested threads ---------------------------------------------------------


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested threads of one source: a comment per line, then one without body."""
    comments = F.transform(
        F.concat(_lines(), F.array(F.lit(None).cast("string"))),
        lambda line, i: F.struct(
            i.cast("string").alias("comment_id"),
            F.col("lang").alias("author"),
            F.lit(None).cast("timestamp").alias("created_at"),
            F.concat(F.lit("> q\n**b** "), line).alias("body"),
        ),
    )
    return table(spark, sf, "documents").select(
        F.lit(vocab.GITHUB).alias("source"),
        F.col("doc_id").cast("string").alias("thread_id"),
        comments.alias("comments"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def open_issues(spark: SparkSession, sf: str) -> DataFrame:
    return recent(without_pull_requests(open_only(issues(spark, sf), value="O")), "updated_at", as_of())

"""Aggregates, top categories, quadrants and report tables over categorised items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.functions import scalars
from voxmill.operators import analyze, classify, replies as model_replies, report
from voxmill.plans import feedback
from voxmill.sinks.tables import cleaned_comments, write_cleaned, write_tables
from voxmill.session import fresh_dir, stored_once
from voxmill.sources.threads import read_items
from workload import views
from workload.registry import query

WITH = f"WITH {views.ITEMS_SQL}"
SCORE_SQL = "CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def long_sql(columns: str) -> str:
    """The five attributes under each other."""
    return " UNION ALL ".join(
        f"SELECT {columns}, '{d}' AS dim, {d} AS value FROM items" for d in analyze.DIMENSIONS
    )


def counts(
    spark: SparkSession, sf: str, *dimensions: str, position: str | None = None
) -> DataFrame:
    return analyze.item_counts(views.items(spark, sf), dimensions or ("priority",), position)


@query(
    "agg1_crosstab",
    f"""{WITH}, long AS ({long_sql("kind, category")})
    SELECT kind, dim, category, value, count(*) AS n FROM long GROUP BY ALL""",
)
def agg1(spark, sf):
    return analyze.crosstab(counts(spark, sf, *analyze.DIMENSIONS))


@query("agg2_category_counts", f"{WITH} SELECT kind, category, count(*) AS n FROM items GROUP BY ALL")
def agg2(spark, sf):
    return analyze.category_counts(counts(spark, sf))


@query(
    "agg3_distributions",
    f"""{WITH}, long AS ({long_sql("kind")})
    SELECT kind, dim, value, count(*) AS n FROM long GROUP BY ALL""",
)
def agg3(spark, sf):
    return analyze.distributions(counts(spark, sf, *analyze.DIMENSIONS))


@query("agg4_totals", f"{WITH} SELECT kind, count(*) AS total_items FROM items GROUP BY ALL")
def agg4(spark, sf):
    return analyze.totals(counts(spark, sf))


@query(
    "agg5_distinct_categories",
    f"{WITH} SELECT kind, count(DISTINCT category) AS categories FROM items GROUP BY ALL",
)
def agg5(spark, sf):
    return analyze.distinct_categories(counts(spark, sf))


@query("set3_distinct", f"{WITH} SELECT DISTINCT kind, category FROM items")
def set3(spark, sf):
    return analyze.category_counts(counts(spark, sf)).select("kind", "category")


MATRIX_SQL = f"""matrix AS (
  SELECT category, count(*) AS frequency, CAST(sum({SCORE_SQL}) AS BIGINT) AS total_priority,
         CAST(sum({SCORE_SQL}) AS DOUBLE) / count(*) AS impact
  FROM items WHERE kind = 'pain_points' GROUP BY 1),
lines AS (SELECT round(avg(frequency), 9) AS mean_frequency, round(avg(impact), 9) AS mean_impact FROM matrix),
placed AS (
  SELECT matrix.*, mean_frequency, mean_impact,
    CASE WHEN round(impact, 9) >= mean_impact AND frequency >= mean_frequency THEN 'High Impact / High Frequency'
         WHEN round(impact, 9) >= mean_impact THEN 'High Impact / Low Frequency'
         WHEN frequency >= mean_frequency THEN 'Low Impact / High Frequency'
         ELSE 'Low Impact / Low Frequency' END AS quadrant
  FROM matrix CROSS JOIN lines)"""


@query("agg6_frequency_impact", f"{WITH}, {MATRIX_SQL} SELECT * FROM matrix")
def agg6(spark, sf):
    return analyze.frequency_impact(counts(spark, sf))


@query("agg7_quadrant_lines", f"{WITH}, {MATRIX_SQL} SELECT * FROM lines")
def agg7(spark, sf):
    return analyze.quadrant_lines(agg6(spark, sf))


@query(
    "win1_quadrants",
    f"{WITH}, {MATRIX_SQL} SELECT category, quadrant, count(*) OVER (PARTITION BY quadrant) AS categories FROM placed",
)
def win1(spark, sf):
    """Every category with its quadrant and how many categories that one has."""
    placed = analyze.with_quadrants(agg6(spark, sf)).select("category", "quadrant")
    return placed.withColumn("categories", F.count(F.lit(1)).over(Window.partitionBy("quadrant")))


@query(
    "join3_priority_score",
    f"{WITH} SELECT priority, {SCORE_SQL} AS score, count(*) AS n FROM items GROUP BY ALL",
)
def join3(spark, sf):
    return (
        views.items(spark, sf)
        .groupBy("priority")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("score", analyze.priority_score(F.col("priority")))
    )


REPLY_TOKENS_SQL = """tokens AS (
  SELECT kind, batch_num, CAST(sum(length(text) // 4) AS BIGINT) AS prompt_tokens,
         count(*) * 50 AS completion_tokens FROM numbered GROUP BY 1, 2)"""


@query(
    "agg8_total_cost",
    f"""WITH {views.ANALYSED_SQL}, {REPLY_TOKENS_SQL}
    SELECT count(*) AS batches,
           CAST(sum(prompt_tokens) * 3 + sum(completion_tokens) * 12 AS DOUBLE) / 1000000 AS total_cost
    FROM tokens""",
)
def agg8(spark, sf):
    return model_replies.total_cost(views.replies(views.batched(spark, sf)))


@query(
    "agg9_run_counters",
    f"""WITH {views.ANALYSED_SQL}
    SELECT count(*) AS threads, CAST(sum(len(pain_points)) AS BIGINT) AS pain_points,
           CAST(sum(len(feature_requests)) AS BIGINT) AS feature_requests FROM analysed""",
)
def agg9(spark, sf):
    return analyze.run_counters(views.analysed(spark, sf))


@query(
    "agg10_high_priority_share",
    f"""{WITH} SELECT kind, category,
    CAST(count(*) FILTER (priority = 'high') AS DOUBLE) / count(*) AS high_priority_share
    FROM items GROUP BY ALL""",
)
def agg10(spark, sf):
    return analyze.high_priority_share(counts(spark, sf))


@query(
    "agg11_high_confidence_share",
    f"""{WITH} SELECT kind,
    CAST(count(*) FILTER (confidence = 'High') AS DOUBLE) / count(*) AS high_confidence_share
    FROM items GROUP BY ALL""",
)
def agg11(spark, sf):
    return analyze.high_confidence_share(counts(spark, sf, "confidence"))


@query("agg12_threads_per_source", "SELECT source, count(*) AS threads FROM documents GROUP BY 1")
def agg12(spark, sf):
    return analyze.threads_per_source(views.table(spark, sf, "documents"))


@query(
    "agg13_theme_mentions",
    """SELECT lang, count(*) AS items,
    count(*) FILTER (contains(lower(text), 'stupid') OR contains(lower(text), 'worthless')) AS mentions
    FROM documents GROUP BY 1""",
)
def agg13(spark, sf):
    docs = views.table(spark, sf, "documents")
    return analyze.theme_mentions(docs, ("stupid", "worthless"), by=("lang",))


@query(
    "agg14_comments_per_file",
    """SELECT source || '.json' AS file_name, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS comments
    FROM documents GROUP BY 1""",
)
def agg14(spark, sf):
    """Counted off the cleaned copies of threads from one file per source."""
    out = fresh_dir(spark, "copies")
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("thread_id"), "source")
    named = views.threads(spark, sf).drop("source", "file_name").join(docs, "thread_id")
    write_cleaned(named.withColumn("file_name", F.concat("source", F.lit(".json"))), out)
    return cleaned_comments(spark, out)


TOP_SQL = """counted AS (SELECT kind, category, count(*) AS n, min(position) AS first_pos FROM items GROUP BY ALL),
top AS (
  SELECT * FROM (
    SELECT kind, category, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first_pos, category) AS place
    FROM counted) WHERE place <= 5)"""


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf, position="position")


@query("top6_top_categories", f"{WITH}, {TOP_SQL} SELECT kind, category, n, place FROM top")
def top6(spark, sf):
    top = analyze.top_categories(first_seen(spark, sf))
    return top.withColumn("place", F.col("place").cast("bigint"))


@query(
    "top7_sorted_counts",
    f"""{WITH} SELECT kind, category, count(*) AS n FROM items GROUP BY ALL ORDER BY n DESC, kind, category""",
)
def top7(spark, sf):
    return agg2(spark, sf).orderBy(F.desc("n"), "kind", "category")


@query(
    "rpt1_pain_point_bars",
    f"{WITH}, {TOP_SQL} SELECT place, category, n FROM top WHERE kind = 'pain_points' ORDER BY place",
)
def rpt1(spark, sf):
    bars = report.pain_point_bars(first_seen(spark, sf))
    return bars.withColumn("place", F.col("place").cast("bigint"))


@query("rpt2_priority_matrix", f"{WITH}, {MATRIX_SQL} SELECT * FROM placed")
def rpt2(spark, sf):
    return report.priority_matrix(counts(spark, sf))


SUMMARY_SQL = f"""{WITH}, {TOP_SQL}, long AS ({long_sql("kind")}), told AS (
SELECT kind, 'total_items' AS section, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM items GROUP BY kind
UNION ALL SELECT kind, 'categories', NULL, count(DISTINCT category) FROM items GROUP BY kind
UNION ALL SELECT kind, dim || '_distribution', value, count(*) FROM long GROUP BY kind, dim, value
UNION ALL SELECT kind, 'top_categories', category, n FROM top)
SELECT *, CAST(NULL AS DOUBLE) AS cost FROM told
UNION ALL SELECT kind, 'total_cost', NULL, NULL,
  CAST(sum((length(text) // 4) * 3 + 50 * 12) AS BIGINT) / CAST(1000000 AS DOUBLE) FROM items GROUP BY kind"""


@query("rpt3_summary", SUMMARY_SQL)
def rpt3(spark, sf):
    """Four tables from the same counts: these are stored, so the items are read once for
    them, and once for what their answers cost at 50 tokens each."""
    counted = counts(spark, sf, *analyze.DIMENSIONS, position="position")
    asked = views.items(spark, sf).withColumn("prompt_tokens", scalars.estimate_tokens(F.col("text")))
    paid = feedback.costs(asked.withColumn("completion_tokens", F.lit(50).cast("bigint")))
    told = report.summary(stored_once(counted, "counts"), paid)
    return told.withColumn("cost", F.col("cost").cast("double"))


@query(
    "rpt4_roadmap",
    f"""{WITH}, {MATRIX_SQL} SELECT category, frequency, impact, quadrant FROM placed
    ORDER BY CASE quadrant WHEN 'High Impact / High Frequency' THEN 0 WHEN 'High Impact / Low Frequency' THEN 1
             WHEN 'Low Impact / Low Frequency' THEN 2 ELSE 3 END,
             round(impact, 9) DESC, frequency DESC, category""",
)
def rpt4(spark, sf):
    return report.roadmap(counts(spark, sf))


@query("snk3_result_tables", f"{WITH}, {MATRIX_SQL} SELECT * FROM placed")
def snk3(spark, sf):
    """Result tables are written and read back."""
    out = fresh_dir(spark, "results")
    write_tables({"matrix": rpt2(spark, sf), "roadmap": rpt4(spark, sf)}, out)
    matrix = spark.read.parquet(f"{out}/matrix")
    roadmap = spark.read.parquet(f"{out}/roadmap").select("category")
    return matrix.join(roadmap, "category")


@query(
    "src8_stored_items",
    f"{WITH}, {MATRIX_SQL} SELECT * FROM placed",
)
def src8(spark, sf):
    """Items are stored and the report is computed again from the store."""
    out = fresh_dir(spark, "items")
    stored = views.items(spark, sf).select("kind", "category", "priority")
    write_tables({"items": stored}, out)
    return report.priority_matrix(analyze.item_counts(read_items(spark, f"{out}/items"), ("priority",)))


@query(
    "join4_listed_category",
    f"""WITH {views.ANALYSED_SQL}, replied AS (
      SELECT item_id, kind, {views.REPLY_CATEGORY_SQL} AS category_raw FROM numbered)
    SELECT item_id, kind, category_raw,
           CASE category_raw WHEN 'Off list' THEN 'Other' ELSE category_raw END AS category FROM replied""",
)
def join4(spark, sf):
    items = views.exploded(spark, sf)
    replied = items.select(
        "item_id", "kind", views.reply_category(F.col("kind"), F.col("text")).alias("category")
    )
    return classify.check_category(replied).select("item_id", "kind", "category_raw", "category")

"""From cleaned threads to analyses, stored answers and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import schemas
from voxmill.functions.scalars import token_cost
from voxmill.operators import analyze, classify, report
from voxmill.operators.items import explode_items
from voxmill.operators.ledger import pending
from voxmill.operators.select import first_per_key
from voxmill.session import fresh_dir
from voxmill.sinks import commits
from voxmill.sinks.tables import stored, write_tables

ClassifyTable = Callable[[DataFrame], DataFrame]
AnalyseTable = Callable[[DataFrame], DataFrame]
#: Shares of the items that are asked for and committed one after the other.
PARTS = 8


def by_lexicon(items: DataFrame) -> DataFrame:
    """The built-in classifier, in the form ``categorise`` takes."""
    return classify.classify_by_lexicon(items).withColumn("status", F.lit(classify.ANSWERED))


def by_cues(threads: DataFrame) -> DataFrame:
    """The built-in analyser, in the form ``analyse`` takes."""
    return classify.analyse_threads(threads, classify.thread_text(F.col("comments")))


def _in_parts(rows: DataFrame, key: Sequence[str], path: str, parts: int, ask: AnalyseTable) -> None:
    """Deal ``rows`` to parts by a hash of their key, and commit what is answered part by part."""
    spark, todo, run = rows.sparkSession, fresh_dir(rows.sparkSession, "open"), uuid.uuid4().hex
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(todo)
    for k in range(parts):
        mine = commits.read_if_there(spark, f"{todo}/_part={k}")
        if mine is not None:
            commits.commit_rows(ask(mine), path, f"{run}-{k}")


def analyse(threads: DataFrame, path: str, analyse_table: AnalyseTable = by_cues, parts: int = PARTS) -> DataFrame:
    """Analyse every cleaned thread that has no stored analysis, in parts, a commit each (CAT5).

    For a callable on pages pass ``lambda threads: analyse_with(threads, fn)``. A thread
    with a page that got no analysis is not stored: the next run asks again. A thread that
    comes twice is asked for once; threads without an id go to ``<path>_unnamed``.
    """
    spark, key = threads.sparkSession, ["source", "thread_id"]
    named = F.col("thread_id").isNotNull()
    threads.where(~named).write.mode("overwrite").parquet(f"{path.rstrip('/')}_unnamed")
    rows = threads.where(named)
    before = stored(spark, path)
    if before is not None:
        done = before.select(*(F.col(k).alias(f"_{k}") for k in key))
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("thread_id") == F.col("_thread_id"))
        rows = rows.join(done, same, "left_anti")
    whole = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in threads.columns))))

    def ask(mine: DataFrame) -> DataFrame:
        found = analyse_table(mine)
        return found.where("n_pages = n_analysed") if "n_analysed" in found.columns else found

    _in_parts(first_per_key(rows, key, whole), key, path, parts, ask)
    analysed = stored(spark, path)
    return ask(spark.createDataFrame([], rows.schema)) if analysed is None else analysed


def from_threads(
    threads: DataFrame,
    path: str,
    analyse_table: AnalyseTable = by_cues,
    classify_table: ClassifyTable = by_lexicon,
) -> DataFrame:
    """Cleaned threads to reports: analyses in ``<path>/analysed``, answers in
    ``<path>/answers``, the reports in ``<path>/reports``; gives the answers. A run that
    died goes on where it was."""
    analysed = analyse(threads, f"{path}/analysed", analyse_table)
    columns = [f.name for f in threads.sparkSession.createDataFrame([], schemas.ANALYSED_THREAD).schema]
    answers = categorise(analysed.select(*columns), f"{path}/answers", classify_table)
    write_reports(threads.sparkSession, answers, f"{path}/reports", f"{path}/answers")
    return answers


def categorise(
    threads: DataFrame,
    path: str,
    classify_table: ClassifyTable = by_lexicon,
    thread_pos: str | None = None,
    parts: int = PARTS,
) -> DataFrame:
    """Categorise every item that has no stored answer and commit the answers (SNK5, CAT1).

    Open items are dealt to ``parts`` by a hash of their id, and every part is one commit:
    a run that dies loses the answers of one part, the next run asks for the rest. Tokens
    that the classifier names are in the same commit. Items that got no answer are not
    stored: the next run asks again. For a callable on texts pass
    ``lambda items: classify_with(items, fn)``.

    A thread that comes twice is asked for once. Threads without an id can't be told apart
    from one another and go to ``<path>_unnamed`` instead. Without ``thread_pos`` items keep
    a place that is made of their id, the same in every run.
    """
    spark = threads.sparkSession
    named = F.col("thread_id").isNotNull()
    threads.where(~named).write.mode("overwrite").parquet(f"{path.rstrip('/')}_unnamed")
    items = explode_items(threads.where(named), thread_pos)
    if thread_pos is None:
        items = items.withColumn("item_pos", F.xxhash64("item_id").cast("decimal(30,0)"))
    before = stored(spark, path)
    if before is not None:
        items = pending(items, before)
    items = first_per_key(items, ["item_id"], "item_pos", "text")
    _in_parts(items, ["item_id"], path, parts, lambda mine: classify_table(mine).where(F.col("status") != classify.UNANSWERED))
    answers = stored(spark, path)
    if answers is None:  # nothing was asked, or nothing answered: no rows, with their columns
        answers = classify_table(spark.createDataFrame([], items.schema))
    return answers


def answer_cost(answers: DataFrame) -> Column:
    """What one answer cost, as a decimal; NULL where the classifier named no tokens."""
    if not {"prompt_tokens", "completion_tokens"} <= set(answers.columns):
        return F.lit(None).cast("decimal(38,9)")
    return token_cost(F.col("prompt_tokens"), F.col("completion_tokens")).cast("decimal(38,9)")


def run_facts(spark: SparkSession, path: str) -> DataFrame:
    """(run, commits, answers, prompt_tokens, completion_tokens, cost) of every run of
    :func:`categorise` on ``path``, as committed."""
    table = commits.read_if_there(spark, f"{path}/data")
    log = commits.commits(spark, path)
    if table is None or log is None:
        return spark.createDataFrame([], "run string, commits bigint, answers bigint, prompt_tokens bigint, completion_tokens bigint, cost decimal(38,9)")
    named = {"prompt_tokens", "completion_tokens"} <= set(table.columns)
    tokens = [F.sum(c if named else F.lit(None).cast("bigint")).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    cost = F.sum(answer_cost(table)).cast("decimal(38,9)").alias("cost")
    sums = table.groupBy(F.substring("commit", 2, 2**31 - 1).alias("commit")).agg(*tokens, cost)
    run = F.regexp_replace("commit", "-[0-9]+$", "").alias("run")
    return log.join(sums, "commit", "left").groupBy(run).agg(
        F.count(F.lit(1)).alias("commits"), F.sum("n_rows").alias("answers"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").cast("decimal(38,9)").alias("cost"),
    )


def costs(answers: DataFrame) -> DataFrame:
    """(kind, cost) of all answers, those in quarantine included, as an exact decimal sum."""
    return answers.groupBy("kind").agg(F.sum(answer_cost(answers)).cast("decimal(38,9)").alias("cost"))


def write_reports(spark: SparkSession, answers: DataFrame, out: str, answers_path: str | None = None) -> None:
    """All report tables. The answers are read three times, for counts, quarantine and
    costs; every report is made from the stored counts. With ``answers_path``, where the
    answers were committed, there is a table ``runs`` of what every run asked and paid."""
    accepted = classify.check_category(classify.accepted(answers))
    counts = analyze.item_counts(accepted, position="item_pos")
    write_tables({"quarantine": classify.quarantined(answers), "counts": counts, "costs": costs(answers)}, out)
    counts = spark.read.parquet(f"{out}/counts")
    if answers_path is not None:
        write_tables({"runs": run_facts(spark, answers_path)}, out)
    write_tables(
        {
            "crosstab": analyze.crosstab(counts),
            "category_counts": analyze.category_counts(counts),
            "summary": report.summary(counts, spark.read.parquet(f"{out}/costs")),
            "pain_point_bars": report.pain_point_bars(counts),
            "priority_matrix": report.priority_matrix(counts),
            "roadmap": report.roadmap(counts),
        },
        out,
    )

"""Analysers of the user's own, and the way from cleaned threads to reports."""

import pytest
from pyspark.sql import functions as F

from voxmill.operators import analyser, classify
from voxmill.plans import feedback
from voxmill.sinks import tables

THREADS = "source string, thread_id string, title string, comments array<struct<cleaned_body: string>>"


def threads(spark, *rows):
    return spark.createDataFrame([(s, i, t, None if c is None else [(b,) for b in c]) for s, i, t, c in rows], THREADS)


def echo():
    """Every line is a pain point, the title the sentiment; the first page is urgent. Workers
    don't know this module, so it is closed in itself."""

    def analyse(pages):
        return [{"pain_points": p["text"].split("\n"), "priority": "low" if p["page"] else "high", "sentiment": p["title"], "prompt_tokens": 7} for p in pages]

    return analyse


def test_pages_hold_whole_threads_in_order(spark):
    long = "".join(chr(97 + k % 26) for k in range(1000))
    rows = threads(spark, ("G", "1", "t", ["a", None, " \n", "b", long, "c"]), ("G", "2", "t", None), ("G", "3", "t", []), (None, None, None, ["é" * 301]))
    got = analyser.pages(rows, ["source", "thread_id"], comments=3, characters=100).orderBy("thread_id", "page").collect()
    one = [r for r in got if r.thread_id == "1"]
    assert [r.page for r in one] == [0, 1, 2, 3, 4] and {r.n_pages for r in one} == {5}
    assert "\n".join(r.text for r in one).split("\n") == ["a", "b", *(long[k : k + 100] for k in range(0, 1000, 100)), "c"]
    assert max(len(r.text) for r in got) <= 3 * 100 + 2
    assert "".join(r.text for r in got if r.thread_id is None).replace("\n", "") == "é" * 301
    assert {r.thread_id for r in got} == {"1", None}


def test_findings_are_put_together(spark):
    rows = threads(spark, ("G", "1", "sad", ["a", "b", "a", "c"]), ("G", None, "glad", ["x"]), (None, None, None, ["y"]), ("G", "9", "t", None))
    rows = rows.withColumn("priority", F.lit("before")).withColumn("page", F.lit(-1))  # clashing names
    out = {(r.source, r.thread_id): r for r in analyser.analyse_with(rows, echo(), comments=2).collect()}
    assert len(out) == 4
    one = out["G", "1"]
    assert (one.pain_points, one.feature_requests, one.sentiment, one.priority, one.user_type) == (["a", "b", "c"], [], "sad", "high", None)
    assert (one.n_pages, one.n_analysed, one.prompt_tokens, one.completion_tokens, one.page) == (2, 2, 14, None, -1)
    assert out["G", None].pain_points == ["x"] and out[None, None].pain_points == ["y"]
    none = out["G", "9"]
    assert (none.pain_points, none.n_pages, none.n_analysed, none.priority) == ([], 0, 0, None)
    assert analyser.analyse_with(rows.where("false"), echo()).count() == 0


def test_voices_and_ties(spark):
    rows = threads(spark, ("G", "1", "t", list("abcdef")), ("G", "2", "t", list("ab")))

    def voices(pages):
        said = {"a": ("pos", "low"), "b": ("neg", "odd"), "c": ("neg", "medium")}
        return [dict(zip(("sentiment", "priority"), said.get(p["text"], (None, None)))) for p in pages]

    out = {r.thread_id: (r.sentiment, r.priority) for r in analyser.analyse_with(rows, voices, comments=1).collect()}
    assert out == {"1": ("neg", "medium"), "2": ("neg", "low")}


def test_pages_without_answer_are_told_and_surplus_fails(spark):
    rows = threads(spark, ("G", "1", "t", list("abc")))
    (row,) = analyser.analyse_with(rows, lambda pages: [None if p["text"] == "b" else {"pain_points": [p["text"]]} for p in pages], comments=1).collect()
    assert (row.pain_points, row.n_pages, row.n_analysed) == (["a", "c"], 3, 2)
    with pytest.raises(Exception, match="analyses of"):
        analyser.analyse_with(rows, lambda pages: [{}] * (len(pages) + 1), comments=1).collect()


def test_pages_of_a_hot_thread_are_dealt_over_tasks(spark):
    rows = threads(spark, ("G", "hot", "t", [f"c{k}" for k in range(4000)]), ("G", "1", "t", ["x"]))
    spread = analyser.pages(rows, ["source", "thread_id"], comments=10).repartition(8, "source", "thread_id", "page")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100
    asked, found = spark.sparkContext.accumulator(0), echo()

    def count(pages):
        asked.add(len(pages))
        assert len(pages) <= 8
        return found(pages)

    out = {r.thread_id: r for r in analyser.analyse_with(rows, count, comments=10).collect()}
    assert out["hot"].pain_points == [f"c{k}" for k in range(4000)] and asked.value == 401


def test_from_threads_to_reports_goes_on_where_it_died(spark, tmp_path):
    """Each thread is analysed once, each item answered once; costs are in the reports."""
    path = str(tmp_path / "run")
    rows = threads(spark, *(("G", str(n), "t", [f"p{n}"]) for n in range(12)), ("G", "3", "t", ["p3"]), ("G", None, "t", ["lost"]), ("G", "later", "t", ["later"]))
    seen, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def analyse(pages):
        seen.add(len(pages))
        return [None if p["text"] == "later" else {"pain_points": [p["text"]], "priority": "high"} for p in pages]

    def answer(texts, kind):
        asked.add(len(texts))
        return [{"text": t, "category": "Other", "confidence": "High", "prompt_tokens": 100, "completion_tokens": 10} for t in texts]

    def run(dies_after=-1):
        left = [dies_after]

        def table(some):
            if left[0] == 0:
                raise KeyboardInterrupt
            left[0] -= 1
            return analyser.analyse_with(some, analyse)

        return feedback.from_threads(rows, path, table, lambda items: classify.classify_with(items, answer))

    with pytest.raises(KeyboardInterrupt):
        run(2)
    first = seen.value
    assert 0 < first < 13 and asked.value == 0
    assert run().count() == 12 and asked.value == 12
    assert tables.stored(spark, f"{path}/analysed").count() == 12
    assert 13 <= seen.value <= 14  # twelve threads once, the one without answer once or twice
    before = seen.value
    assert run().count() == 12 and asked.value == 12 and seen.value == before + 1
    assert [r.thread_id for r in spark.read.parquet(f"{path}/analysed_unnamed").collect()] == [None]
    summary = spark.read.parquet(f"{path}/reports/summary").where("section = 'total_cost'").collect()
    assert [(r.kind, float(r.cost)) for r in summary] == [("pain_points", pytest.approx(12 * (100 * 3 + 10 * 12) / 1e6))]
    runs = spark.read.parquet(f"{path}/reports/runs").collect()
    assert [(r.answers, r.prompt_tokens) for r in runs] == [(12, 1200)]


def test_from_threads_with_what_is_built_in(spark, tmp_path):
    rows = threads(spark, ("G", "1", "t", ["Sync will crash. Please add tags."]), ("G", "2", "t", ["Fine."]))
    answers = feedback.from_threads(rows, str(tmp_path))
    assert {(r.kind, r.text) for r in answers.collect()} == {("pain_points", "Sync will crash"), ("feature_requests", "Please add tags")}
    assert {r.cost for r in spark.read.parquet(f"{tmp_path}/reports/costs").collect()} == {None}
    empty = feedback.from_threads(rows.where("false"), str(tmp_path / "none"))
    assert empty.count() == 0

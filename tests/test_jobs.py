"""Sinks, streams and whole jobs, run more than once."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from voxmill import schemas
from voxmill.operators import classify
from voxmill.plans import collect, feedback
from voxmill.session import shared_root, stored_once
from voxmill.sinks import tables
from voxmill.sources import payloads
from voxmill.streaming import collect as streaming

AS_OF = dt.datetime(2024, 7, 1)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, thread_id string, n int")


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.stored(spark, path) is None
    assert tables.append_new(rows(spark, ("a", "1", 2), ("a", "1", 1), ("b", "1", 3)), path, ["source", "thread_id"], "n")
    assert not tables.append_new(rows(spark, ("a", "1", 9)), path, ["source", "thread_id"], "n")
    assert tables.append_new(rows(spark, ("a", "1", 9), ("c", "2", 4)), path, ["source", "thread_id"], "n")
    out = {(r.source, r.thread_id, r.n) for r in tables.stored(spark, path).collect()}
    assert out == {("a", "1", 1), ("b", "1", 3), ("c", "2", 4)}


def test_prepare_sees_new_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_new(rows(spark, ("a", "1", 1)), path, ["thread_id"], "n")
    tables.append_new(
        rows(spark, ("a", "1", 1), ("a", "2", 2)), path, ["thread_id"], "n",
        prepare=lambda new: new.withColumn("n", F.assert_true(F.col("thread_id") == "2").cast("int")),
    )
    assert tables.stored(spark, path).count() == 2


def test_other_read_errors_are_not_swallowed(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.stored(spark, str(tmp_path / "x.parquet")).collect()


def test_stream_takes_every_item_once(spark, tmp_path):
    landing, sink, progress = (str(tmp_path / d) for d in ("landing", "sink", "progress"))
    schema = "source string, thread_id string, n int"

    def land(*pairs):
        rows(spark, *pairs).write.mode("append").json(landing)

    def drain(checkpoint):
        stream = streaming.landed(spark, landing, schema, files_per_batch=1)
        streaming.collect(stream, sink, checkpoint, ["source", "thread_id"], "n").awaitTermination()
        return sorted((r.source, r.thread_id) for r in tables.stored(spark, sink).collect())

    land(("a", "1", 1), ("a", "1", 1), ("b", "1", 1))
    assert drain(progress) == [("a", "1"), ("b", "1")]
    land(("a", "1", 5), ("a", "2", 1))
    assert drain(progress) == [("a", "1"), ("a", "2"), ("b", "1")]
    # A lost checkpoint reads everything again and adds nothing.
    assert drain(progress + "-new") == [("a", "1"), ("a", "2"), ("b", "1")]


def test_stream_with_bounded_state(spark, tmp_path):
    landing, sink, progress = (str(tmp_path / d) for d in ("landing", "sink", "progress"))
    schema = "thread_id string, ts timestamp"
    for second in (0, 1):
        moment = dt.datetime(2024, 1, 1, 0, 0, second)
        spark.createDataFrame([("1", moment), ("2", moment)], schema).write.mode("append").json(landing)
        stream = streaming.landed(spark, landing, schema)
        streaming.collect_within(stream, sink, progress, ["thread_id"], "ts", "10 minutes").awaitTermination()
    assert sorted(r.thread_id for r in spark.read.parquet(sink).collect()) == ["1", "2"]


def issue(n, reactions, comments, state="open", pull=None, updated="2024-06-01T00:00:00Z"):
    return json.dumps(
        {
            "id": n, "number": n, "title": "t", "user": {"login": "a"}, "state": state, "pull_request": pull,
            "reactions": {"total_count": reactions}, "comments": comments, "created_at": "2020-01-01T00:00:00Z",
            "updated_at": updated, "labels": [], "comment_list": [],
        }
    )


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def ids(found):
    return sorted(r.thread_id for r in found.threads.collect())


def test_collect_issues(spark):
    landed = lines(spark, [
        issue(1, 9, 0), issue(2, 0, 9), issue(3, 5, 5), issue(4, 1, 1), issue(5, 50, 0, state="closed"),
        issue(6, 50, 0, pull={}), issue(7, 50, 0, updated="2023-01-01T00:00:00Z"),
    ])

    def found(**kw):
        return ids(collect.collect_issues(landed, AS_OF, **kw))

    assert found() == ["1", "2", "3", "4"]
    # Two lists of two: {1, 3} and {2, 3}; 3 leads with ten, 1 comes before 2.
    assert found(k=2) == ["1", "3"]
    done = spark.createDataFrame([("GitHub", "3"), ("Reddit", "1")], "source string, item_id string")
    assert found(k=2, ledger=done) == ["1"]  # not the next best instead


def test_first_list_is_ranked_by_plus_one(spark):
    texts = [json.loads(issue(n, total, 0)) for n, total in ((1, 50), (2, 9), (3, 8))]
    for one, plus in zip(texts, (0, 9, 8)):
        one["reactions"]["+1"] = plus
    landed = lines(spark, map(json.dumps, texts))
    assert ids(collect.collect_issues(landed, AS_OF, k=1)) == ["1"]  # first by comments: all tie, 1 comes first
    texts[0]["comments"] = -1
    assert ids(collect.collect_issues(lines(spark, map(json.dumps, texts)), AS_OF, k=1)) == ["2"]


def test_a_thread_counts_once_with_its_last_version(spark):
    """Landed twice, changed, reopened, closed: only the last version is looked at."""
    landed = spark.createDataFrame(
        [
            (1, issue(1, 9, 0)), (2, issue(1, 9, 0)), (1, issue(2, 99, 0)), (2, issue(2, 1, 0)),
            (1, issue(3, 5, 0, state="closed")), (2, issue(3, 5, 0)), (1, issue(4, 70, 0)), (2, issue(4, 70, 0, state="closed")),
        ],
        "value int, text string",
    )
    found = collect.collect_issues(landed, AS_OF, k=2, text="text", version="value")
    assert ids(found) == ["1", "3"] and found.counts == {"landed": 8, "quarantined": 0}
    # Without a version the last update counts.
    again = lines(spark, [issue(1, 9, 0, updated="2024-06-02T00:00:00Z", state="closed"), issue(1, 9, 0, updated="2024-06-01T00:00:00Z")])
    assert ids(collect.collect_issues(again, AS_OF)) == []


def test_what_cannot_be_ranked_is_in_quarantine_before_the_ranking(spark):
    no_author = json.loads(issue(5, 90, 0)) | {"user": None}
    odd = json.loads(issue(6, 80, 0)) | {"comment_list": "none"}
    texts = [issue(1, 9, 0), "{broken", None, "", "[]", '{"id": "x"}', issue(2, 1, 0, updated="soon"), json.dumps(no_author), json.dumps(odd)]
    found = collect.collect_issues(lines(spark, texts), AS_OF, k=3)
    assert ids(found) == ["1"] and found.counts == {"landed": 9, "quarantined": 6}
    bad = {(r.problem, r.raw) for r in found.quarantine.collect()}
    assert {(p, t) for p, t in bad if p in ("no author", "no time")} == {("no author", texts[7]), ("no time", texts[6])}
    assert {t for p, t in bad if p == "unreadable"} >= {"{broken", '{"id": "x"}', texts[8]}
    assert {t for _, t in bad} == {texts[n] for n in range(1, 9)}
    nothing = collect.collect_issues(lines(spark, []), AS_OF)
    assert ids(nothing) == [] and nothing.quarantine.count() == 0 and nothing.counts == {"landed": 0, "quarantined": 0}


def test_comments_are_parsed_for_winners_only(spark, monkeypatch):
    """The ranking's own parse knows no comments; the whole schema comes after the join."""
    plans = []

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return stored_once(df, name)

    monkeypatch.setattr(collect, "stored_once", spy)
    sifted = []
    whole = payloads.sift

    def sift(*args, **kw):
        sifted.append(args[2])
        return whole(*args, **kw)

    monkeypatch.setattr(payloads, "sift", sift)
    collect.collect_issues(lines(spark, [issue(1, 9, 0)]), AS_OF)
    assert len(sifted) == 1 and "comment_list" not in sifted[0] and "body" not in sifted[0]
    by_name = dict(plans)
    assert "from_json" not in by_name["candidates"].lower().replace("jsontostructs", "from_json")
    top, _, below = by_name["winners"].partition("Join")
    assert "comment_list" in top and "comment_list" not in below


def test_store_keeps_threads_quarantine_and_numbers(spark, tmp_path):
    path = str(tmp_path / "threads")
    landed = lines(spark, [issue(1, 9, 0), issue(2, 5, 0), "{broken"])
    assert collect.ledger_at(spark, path) is None
    first = collect.collect_issues(landed, AS_OF)
    assert collect.store(first, path, "one") == 2
    assert collect.store(first, path, "one") == 2  # run again under its name: the same numbers, nothing added
    more = lines(spark, [issue(1, 9, 0), issue(3, 5, 0), "{broken", "{too"])
    assert collect.store(collect.collect_issues(more, AS_OF, collect.ledger_at(spark, path)), path, "two") == 1
    post = {"id": "a", "permalink": "/x", "title": "t", "score": 1, "num_comments": 0, "created_utc": AS_OF.timestamp()}
    assert collect.store(collect.collect_posts(lines(spark, [json.dumps(post)]), AS_OF, collect.ledger_at(spark, path)), path, "two") == 1
    held = tables.stored(spark, path)
    assert sorted((r.source, r.thread_id) for r in held.collect()) == [("GitHub", "1"), ("GitHub", "2"), ("GitHub", "3"), ("Reddit", "a")]
    assert {r.score for r in held.where("source = 'Reddit'").collect()} == {1}
    assert sorted(r.raw for r in tables.stored(spark, f"{path}_quarantine").collect()) == ["{broken", "{too"]
    runs = sorted((r.source, r.landed, r.quarantined, r.collected, r.stored) for r in tables.stored(spark, f"{path}_runs").collect())
    assert runs == [("GitHub", 3, 1, 2, 2), ("GitHub", 4, 2, 1, 1), ("Reddit", 1, 0, 1, 1)]


def test_collect_posts(spark):
    def post(n, score, comments, created):
        return json.dumps({"id": n, "permalink": "/x", "title": "t", "score": score, "num_comments": comments, "created_utc": created})

    recent, old = AS_OF.timestamp() - 86400, 1500000000
    texts = [post("a", 9, 0, recent), post("b", 0, 8, recent), post("c", 99, 99, old), post("d", 1, 1, recent), post("a", 9, 0, recent)]
    landed = lines(spark, texts)

    def found(**kw):
        return ids(collect.collect_posts(landed, AS_OF, **kw))

    assert found() == ["a", "b", "d"]
    assert found(k=1) == ["a"]
    assert found(candidates=1) == []  # the leader is old; the lists are cut before the date is looked at


def test_collect_topics(spark):
    def topic(n, category, replies, views):
        return json.dumps({"id": n, "slug": "s", "title": "t", "category_id": category, "reply_count": replies, "views": views,
                           "created_at": "2024-06-01T00:00:00Z", "post_stream": {"posts": []}})

    texts = [topic(1, 5, 1, 9), topic(2, 5, 0, 25), topic(3, 7, 0, 0), topic(4, 9, 99, 0), topic(5, 5, 1, 0), topic(2, 5, 0, 25)]
    assert ids(collect.collect_topics(lines(spark, texts), AS_OF, "https://f", k=2)) == ["1", "2", "3"]


ANALYSED = "thread_id string, source string, sentiment string, priority string, user_type string, pain_points array<string>, feature_requests array<string>, pos bigint"


def test_feedback_job_resumes_by_id(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)
    answers, out = str(tmp_path / "answers"), str(tmp_path / "reports")

    def lazy(texts, kind):
        """Answers nothing for a text that says so, and once off list."""
        asked.add(len(texts))
        replies = [{"text": t, "category": "Mystery" if "odd" in t else "File Handling", "confidence": "High"} for t in texts]
        return replies[: len(texts) - sum("later" in t for t in texts)]

    def run(*threads):
        frame = spark.createDataFrame(list(threads), ANALYSED).coalesce(1)
        return feedback.categorise(frame, answers, lambda items: classify.classify_with(items, lazy), "pos")

    first = ("1", "GitHub", "bad", "high", "dev", ["a", "odd"], ["f"], 1)
    second = ("2", "GitHub", "bad", "low", "dev", ["b", "later"], None, 2)
    assert run(first).count() == 3 and asked.value == 3
    assert run(first, second).count() == 4 and asked.value == 5
    assert run(first, second).count() == 4 and asked.value == 6  # only the open one is asked again
    feedback.write_reports(spark, tables.stored(spark, answers), out)
    matrix = {r.category: (r.frequency, r.total_priority, r.impact) for r in spark.read.parquet(f"{out}/priority_matrix").collect()}
    assert matrix == {"File Handling": (2, 4, 2.0), "Other": (1, 3, 3.0)}
    summary = {(r.kind, r.section, r.name): r.n for r in spark.read.parquet(f"{out}/summary").collect()}
    assert summary["pain_points", "total_items", None] == 3
    assert summary["pain_points", "priority_distribution", "high"] == 2
    assert summary["feature_requests", "categories", None] == 1
    assert [r.category for r in spark.read.parquet(f"{out}/roadmap").collect()] == ["Other", "File Handling"]
    assert spark.read.parquet(f"{out}/quarantine").count() == 0


def test_feedback_job_killed_half_way(spark, tmp_path):
    """What was committed is not asked again; tokens are counted once, and add up."""
    asked = spark.sparkContext.accumulator(0)
    path = str(tmp_path / "answers")
    frame = spark.createDataFrame([(str(t), "GitHub", "bad", "high", "dev", [f"p{t}-{k}" for k in range(6)], None, t) for t in range(8)], ANALYSED).coalesce(1)

    def job(dies_after):
        left = [dies_after]

        def answer(texts, kind):
            asked.add(len(texts))
            return [{"text": t, "category": "Other", "confidence": "Low", "prompt_tokens": 1000, "completion_tokens": 10} for t in texts]

        def ask(items):
            if left[0] == 0:
                raise KeyboardInterrupt
            left[0] -= 1
            return classify.classify_with(items, answer)

        return feedback.categorise(frame, path, ask, "pos", parts=5)

    with pytest.raises(KeyboardInterrupt):
        job(3)
    first = asked.value
    assert 0 < first < 48 and tables.stored(spark, path).count() == first
    assert job(-1).count() == 48 and asked.value == 48
    assert job(-1).count() == 48 and asked.value == 48
    facts = feedback.run_facts(spark, path).orderBy("answers").collect()
    assert sorted(f["answers"] for f in facts) == sorted((first, 48 - first)) and {f.commits for f in facts} == {3, 2}
    assert sum(f.prompt_tokens for f in facts) == 48_000 and float(sum(f.cost for f in facts)) == pytest.approx(48 * (1000 * 3 + 10 * 12) / 1e6)


def test_feedback_job_and_threads_without_id(spark, tmp_path):
    frame = spark.createDataFrame([(None, "G", "s", "high", "u", ["sync lost"], None, 1), (None, "G", "s", "high", "u", ["theme"], None, 2),
                                   ("1", "G", "s", "high", "u", ["crash"], ["export"], 3), ("1", "G", "s", "high", "u", ["crash"], ["export"], 3)], ANALYSED)
    done = feedback.categorise(frame, str(tmp_path / "a"), thread_pos="pos")
    assert sorted(r.text for r in done.collect()) == ["crash", "export"]
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "a_unnamed")).collect()) == [1, 2]
    none = feedback.categorise(frame.where("false"), str(tmp_path / "b"))
    assert none.count() == 0 and "category" in none.columns


def test_feedback_job_with_the_lexicon(spark, tmp_path):
    frame = spark.createDataFrame([("1", "G", "s", "high", "u", ["sync lost"], ["dark theme"], 1)], ANALYSED).drop("pos")
    done = feedback.categorise(frame, str(tmp_path / "a"))
    assert {r.kind: r.category for r in done.collect()} == {
        "pain_points": "Sync & Data Management", "feature_requests": "UI/UX Enhancements",
    }


def test_shared_folder(spark):
    assert shared_root(spark) == shared_root(spark)
    assert stored_once(spark.range(3), "numbers").count() == 3


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        pass

    class Cluster:
        conf = Conf({"spark.master": "spark://host:7077"})

        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Cluster)
    Cluster.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_root(Cluster) == "hdfs://x/y"

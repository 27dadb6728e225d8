"""Thread files, payloads and their odd records."""

import datetime as dt
import json

from support import plan_of
from pyspark.sql import functions as F

from voxmill import schemas
from voxmill.operators.analyze import comments_per_file
from voxmill.operators.clean import clean_threads
from voxmill.plans.clean import clean_files
from voxmill.sources import payloads, threads

THREADS = [
    {
        "source": "Discourse",
        "thread_id": 5,
        "mood": {"a": 1},
        "created_at": "2024-01-01T00:00:00Z",
        "comments": [
            {"comment_id": 1, "body": "x <b>y</b>"},
            {"comment_id": "q", "body": 5},
            {"comment_id": "z"},
            {"comment_id": "n", "body": None},
            7,
        ],
    },
    {"source": "GitHub", "issue_id": 9, "issue_number": 3, "labels": ["bug"], "comments": []},
    {"comments": [{"body": "**é**"}]},
    7,
    "text",
    {"title": "no comments"},
]


def land(path, name, value):
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_array_files(spark, tmp_path):
    land(tmp_path, "a.json", THREADS)
    land(tmp_path, "a_cleaned.json", THREADS)
    land(tmp_path, "bad.json", '[{"a":')
    land(tmp_path, "object.json", {"root": "is no list"})
    land(tmp_path, "notes.txt", "[]")
    out = clean_threads(threads.read_threads(spark, str(tmp_path))).orderBy("pos").collect()
    assert {r.file_name for r in out} == {"a.json"} and len(out) == 6
    assert [r.source for r in out] == ["Discourse", "GitHub", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert [r.thread_id for r in out][:2] == ["5", "9"]
    assert out[0].created_at == dt.datetime(2024, 1, 1) and out[0].extra == '{"mood":{"a":1}}'
    assert [c.cleaned_body for c in out[0].comments] == ["x y", "", "", "", ""]
    assert [c.comment_id for c in out[0].comments] == ["1", "q", "z", "n", None]
    assert out[1].comments == [] and out[1].labels == ["bug"] and out[1].issue_number == 3
    assert out[2].comments[0].cleaned_body == "é"
    assert [r.comments for r in out[3:]] == [None, None, None]


def test_json_lines(spark, tmp_path):
    lines = "\n".join(json.dumps(t) for t in THREADS) + "\n{broken\n"
    land(tmp_path, "a.json", lines)
    out = threads.read_threads(spark, str(tmp_path), json_lines=True)
    assert out.count() == 6  # the broken line is in quarantine instead
    assert comments_per_file(out).collect()[0].comments == 2


def test_cleaning_needs_no_shuffle_and_no_python(spark, tmp_path):
    land(tmp_path, "a.json", "\n".join(map(json.dumps, THREADS)))
    plan = plan_of(clean_threads(threads.read_threads(spark, str(tmp_path), json_lines=True)))
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan


def test_clean_files(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    land(source, "a.json", THREADS)
    land(source, "b.json", THREADS[2:3])
    counts = clean_files(spark, str(source), str(out))
    assert {r.file_name: r.comments for r in counts.collect()} == {"a.json": 2, "b.json": 1}
    assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["dataset=a_cleaned", "dataset=b_cleaned"]
    written = [p.read_text(encoding="utf-8") for p in (out / "dataset=b_cleaned").glob("*.json")]
    assert '"cleaned_body":"é"' in "".join(written)


def test_files_are_told_apart_by_path_and_copies_are_no_input(spark, tmp_path):
    """Two files of one name stay two, also beside their own copies, however they are read."""
    source = tmp_path / "in_cleaned" / "x y"  # the root's own name says nothing
    for folder, some in (("a", THREADS), ("b", THREADS[2:3]), ("b/deep", THREADS[:1])):
        (source / folder).mkdir(parents=True)
        land(source / folder, "t.json", some)
    out = str(source / "done")
    wanted = {"a/t.json": 2, "b/t.json": 1, "b/deep/t.json": 1}
    for _ in range(2):
        counts = clean_files(spark, str(source), out)
        assert {r.file_name: r.comments for r in counts.collect()} == wanted
    assert sorted(p.name for p in (source / "done").iterdir() if p.is_dir()) == [
        f"dataset={n}%2Ft_cleaned" for n in ("a", "b%2Fdeep", "b")
    ]
    for kw in ({}, {"split": True}):
        names = threads.read_threads(spark, f"file:{source}/", **kw).groupBy("file_name").count().collect()
        assert {r.file_name: r["count"] for r in names} == {"a/t.json": 6, "b/t.json": 1, "b/deep/t.json": 1}
    (one,) = threads.read_threads(spark, str(source / "b" / "t.json")).collect()
    assert one.file_name == "t.json"
    assert {r.file_name for r in threads.read_threads(spark, f"{source}/*/t.json").collect()} == {"a/t.json", "b/t.json"}


def test_array_file_above_the_variant_limit(spark, tmp_path):
    with open(tmp_path / "big.json", "w", encoding="utf-8") as file:
        file.write("[")
        for k in range(1400):
            file.write(("," if k else "") + json.dumps({"thread_id": k, "comments": [{"body": "x" * 100 * 1024}], "mood": k}) + "\n")
        file.write("]")
    read = threads.read_threads(spark, str(tmp_path))
    found = read.select(F.count("*"), F.countDistinct("thread_id"), F.sum(F.length(F.col("comments")[0]["body"])), F.count("extra")).first()
    assert tuple(found) == (1400, 1400, 1400 * 100 * 1024, 1400)
    assert threads.unreadable_files(spark, str(tmp_path)).count() == 0


def test_clean_files_names_what_it_cannot_read(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    bad = {"bad.json": '[{"a":', "object.json": '{"a": 1}', "two.json": '[{"a": 1}]\n[{"b": 2}]', "twice.json": '[1], [2]', "tail.json": "[1] x", "key.json": '[{"a": 1, "a": 2}, 3]'}
    for name, text in bad.items():
        land(source, name, text)
    land(source, "a.json", THREADS)
    land(source, "odd.json", "\ufeff" + json.dumps([None, [1], {"comments": [{"body": "x"}]}], indent=2))
    land(source, "none.json", " [ ] ")
    counts = clean_files(spark, str(source), str(out) + "/")
    assert {r.file_name: r.comments for r in counts.collect()} == {"a.json": 2, "odd.json": 1}
    lost = spark.read.parquet(f"{out}_quarantine").collect()
    assert {r.path.rsplit("/", 1)[1]: r.text for r in lost} == bad
    assert {r.path.rsplit("/", 1)[1] for r in lost if r.reason == "no list"} == {"object.json"}


def test_clean_files_keeps_broken_lines(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    land(source, "a.json", "\n".join(map(json.dumps, THREADS)) + "\n{broken\n")
    clean_files(spark, str(source), str(out), json_lines=True)
    assert [(r.reason, r.text) for r in spark.read.parquet(f"{out}_quarantine").collect()] == [("unreadable", "{broken")]


def test_issues(spark, tmp_path):
    good = {
        "id": 1, "number": 2, "html_url": "u", "title": "t", "user": {"login": "ann"}, "state": "open", "body": None,
        "labels": [{"name": "bug"}, {"name": "ui"}], "created_at": "2024-01-01T00:00:00Z", "pull_request": {"url": "x"},
        "comment_list": [{"id": 4, "user": {"login": "bob"}, "created_at": "2024-01-02T00:00:00+00:00", "body": "hi"}],
    }
    bad = [
        {**good, "user": None},
        {**good, "created_at": "soon"},
        {**good, "comment_list": [{**good["comment_list"][0], "user": None}]},
        {**good, "comment_list": [{**good["comment_list"][0], "created_at": None}]},
        {**good, "id": None},
    ]
    land(tmp_path, "p.json", "\n".join(map(json.dumps, [good, *bad])) + "\n{broken")
    raw = payloads.read_payloads(spark, str(tmp_path / "p.json"), schemas.ISSUE_PAYLOAD)
    done = payloads.normalise_issues(raw)
    (row,) = payloads.sound(done).collect()
    assert (row.source, row.thread_id, row.issue_number, row.author, row.labels) == ("GitHub", "1", 2, "ann", ["bug", "ui"])
    assert [(c.comment_id, c.author, c.body) for c in row.comments] == [("0", "ann", ""), ("4", "bob", "hi")]
    problems = {r.problem for r in payloads.quarantine(done).collect()}
    assert problems == {"no author", "no time", "comment without author", "comment without time", "no id", "unreadable"}
    assert "Exchange" not in plan_of(done)


def test_posts(spark):
    good = {
        "id": "p1", "permalink": "/r/x", "title": "t", "author": None, "score": 3, "num_comments": 2,
        "created_utc": 1700000000.0, "selftext": None,
        "comment_list": [
            {"id": "c1", "author": None, "created_utc": 1700000001, "body": "b"},
            {"id": "c2", "author": "x", "created_utc": 1700000002},
            {"id": "c3", "author": "x", "created_utc": 1700000003, "body": ""},
        ],
    }
    rows = spark.createDataFrame([(json.dumps(good),), (json.dumps({**good, "created_utc": None}),), ("{",), (None,)], "p string")
    done = payloads.normalise_posts(payloads.parse_payloads(rows, "p", schemas.POST_PAYLOAD))
    (row,) = payloads.sound(done).collect()
    assert (row.url, row.author, row.score) == ("https://reddit.com/r/x", "[deleted]", 3)
    assert row.created_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert [(c.comment_id, c.author, c.body) for c in row.comments] == [("p1", "[deleted]", ""), ("c1", "[deleted]", "b"), ("c3", "x", "")]
    assert sorted(r.problem for r in payloads.quarantine(done).collect()) == ["no id", "no time", "unreadable"]


def test_topics(spark):
    post = {"id": 8, "created_at": "2024-01-01T00:00:00Z", "cooked": " <p>a</p>\n"}
    good = {"id": 7, "slug": "s", "title": "t", "created_at": "2024-01-01T00:00:00Z", "post_stream": {"posts": [post]}}
    cases = [good, {**good, "slug": None}, {**good, "post_stream": {"posts": [{**post, "id": None}]}}, {**good, "post_stream": None}]
    rows = spark.createDataFrame([(json.dumps(c),) for c in cases], "p string")
    done = payloads.normalise_topics(payloads.parse_payloads(rows, "p", schemas.TOPIC_PAYLOAD), "https://f/")
    first, empty = sorted(payloads.sound(done).collect(), key=lambda r: -len(r.comments))
    assert (first.url, first.author, first.reply_count, first.views) == ("https://f/t/s/7", "unknown", 0, 0)
    assert [(c.comment_id, c.author, c.body) for c in first.comments] == [("8", "unknown", "<p>a</p>")]
    assert empty.comments == []
    assert {r.problem for r in payloads.quarantine(done).collect()} == {"no slug", "post without id"}


def test_analysed_threads(spark, tmp_path):
    land(tmp_path, "a.json", [{"thread_id": 1, "source": "S", "pain_points": ["a"]}])
    (row,) = threads.read_analysed(spark, str(tmp_path)).collect()
    assert (row.thread_id, row.pain_points, row.feature_requests) == ("1", ["a"], None)


def test_payload_text_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "p string")
    plan = plan_of(payloads.normalise_issues(payloads.parse_payloads(rows, "p", schemas.ISSUE_PAYLOAD)))
    assert plan.count("from_json(") == 1


def test_schemas_are_ddl(spark):
    for name in ("THREAD", "ANALYSED_THREAD", "ITEM", "CATEGORISED_ITEM", "LEDGER"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
    assert spark.createDataFrame([], schemas.THREAD).select(F.explode("comments")).count() == 0


def test_unreadable_files_are_named(spark, tmp_path):
    land(tmp_path, "a.json", THREADS)
    land(tmp_path, "bad.json", '[{"a":')
    land(tmp_path, "object.json", {"root": "is no list"})
    land(tmp_path, "bad_cleaned.json", "[")
    found = {(r.path.rsplit("/", 1)[1], r.reason) for r in threads.unreadable_files(spark, str(tmp_path)).collect()}
    assert found == {("bad.json", "unreadable"), ("object.json", "no list")}


def test_broken_lines_keep_their_text(spark, tmp_path):
    land(tmp_path, "a.json", "\n".join(map(json.dumps, THREADS)) + "\n{broken\n\n")
    found = threads.unreadable_lines(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in found] == [("a.json", "{broken")]
    assert threads.read_threads(spark, str(tmp_path), json_lines=True).count() == len(THREADS)

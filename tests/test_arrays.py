"""One array file read by many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from voxmill.sources import arrays, threads

rng = random.Random(4)
TEXTS = ["plain", "", "a } b", "{ [ ] } , ", 'quote " and \\\\ and \\"', "\\\\", 'ends with \\\\"}', "é 漢 \U0001f389", "line\nbreak", "]", "},{", '"', "\\"]


def value(depth):
    kind = rng.randrange(6 if depth else 3)
    if kind == 0:
        return rng.choice([None, True, 3, -2.5, 10**12])
    if kind in (1, 2):
        return "".join(rng.choices(TEXTS, k=3))
    if kind == 3:
        return [value(depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TEXTS) or "k": value(depth - 1) for _ in range(rng.randrange(4))}


def found(spark, path):
    records, bad = arrays.read_array_elements(spark, str(path))
    rows = records.select("file_name", "pos", F.to_json("record").alias("r")).orderBy("file_name", "pos").collect()
    return [(r.file_name, json.loads(r.r)) for r in rows], sorted(p.path.rsplit("/", 1)[1] for p in bad.collect())


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_every_element_once_and_in_order(spark, tmp_path, small_ranges):
    lists = {
        "a.json": [value(3) for _ in range(120)],
        "b.json": [{"body": "x" * 3000, "n": k} for k in range(5)],
        "c.json": [1, "two", [3, {"four": 5}], {"six": {}}, {}, [], None, "last"],
        "d.json": [], "e.json": [{}], "f.json": ["no object } at all"],
    }
    for k, (name, own) in enumerate(lists.items()):
        text = json.dumps(own, ensure_ascii=k % 2 == 0, indent=None if k % 3 else 2)
        (tmp_path / name).write_text(("\ufeff" if name == "e.json" else "") + text + ("\n" if k % 2 else ""))
    got, bad = found(spark, tmp_path)
    assert bad == []
    assert got == [(name, x) for name, own in sorted(lists.items()) for x in own]
    ranges = arrays._fragments(spark, str(tmp_path)).where(F.col("file_name") == "b.json")
    assert ranges.select("start").distinct().count() > 1


def test_files_that_are_no_sound_list(spark, tmp_path, small_ranges):
    bad = {"cut.json": '[{"a": 1}, {"b": ', "object.json": '{"a": 1}', "two.json": '[{"a": 1}] [{"b": 2}]', "comma.json": '[{"a": 1}, ]',
           "missing.json": '[{"a": 1} {"b": 2}]', "open.json": '[{"a": "x}]', "more.json": '[{"a": 1}]]', "word.json": "[{}, nonsense]"}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    assert found(spark, tmp_path) == ([("good.json", {"a": 1})], sorted(bad))


def test_the_same_threads_as_the_whole_file_reader(spark, tmp_path, small_ranges):
    own = [{"thread_id": str(k), "source": "GitHub", "title": value(0) and "t", "comments": [{"body": t, "author": "a"} for t in rng.choices(TEXTS, k=3)]} for k in range(40)]
    (tmp_path / "threads.json").write_text(json.dumps(own))
    (tmp_path / "threads_cleaned.json").write_text(json.dumps(own))
    whole, split = (threads.read_threads(spark, str(tmp_path), split=s).drop("pos").collect() for s in (False, True))
    assert len(split) == 40 and sorted(map(str, split)) == sorted(map(str, whole))


def test_a_large_array_is_read_by_eight_tasks(spark, tmp_path):
    n, body = 24_000, "words and } more { words " * 50
    with open(tmp_path / "large.json", "w") as out:
        out.write("[" + ",".join(json.dumps({"thread_id": str(k), "body": body}) for k in range(n)) + "]")
    size = (tmp_path / "large.json").stat().st_size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 8 + 1))
    try:
        records, bad = arrays.read_array_elements(spark, str(tmp_path))
        ids = records.select(F.try_variant_get("record", "$.thread_id", "string").alias("i"), F.length(F.try_variant_get("record", "$.body", "string")).alias("n"))
        assert ids.agg(F.count("i"), F.count_distinct("i"), F.min("n"), F.max("n")).first() == (n, n, len(body), len(body))
        assert bad.count() == 0
        starts = arrays._fragments(spark, str(tmp_path)).groupBy("start").count().collect()
        assert len(starts) == 8 and min(r["count"] for r in starts) > 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

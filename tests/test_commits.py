"""Commits: whole or not at all, and once."""

import pytest
from support import plan_of
from pyspark.sql import functions as F

from voxmill.sinks import commits, tables
from voxmill.streaming import collect as streaming

SCHEMA = "source string, thread_id string, n int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(spark, path):
    table = commits.read_committed(spark, path)
    return [] if table is None else sorted(map(tuple, table.select("source", "thread_id", "n").collect()), key=str)


KEYS = ["source", "thread_id"]


def test_a_commit_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.read_committed(spark, path) is None and not commits.is_committed(spark, path, "1")
    assert commits.append_once(rows(spark, ("a", "1", 2), ("a", "1", 1), ("b", "1", 3)), path, "1", KEYS, "n") == 2
    assert commits.append_once(rows(spark, ("z", "9", 9)), path, "1", KEYS, "n") == 0
    assert commits.append_once(rows(spark, ("a", "1", 7)), path, "2", KEYS, "n") == 0
    assert commits.append_once(rows(spark, ("a", "2", 7), ("b", "1", 0)), path, "007", KEYS, "n") == 1
    assert held(spark, path) == [("a", "1", 1), ("a", "2", 7), ("b", "1", 3)]
    assert sorted(map(tuple, commits.commits(spark, path).collect())) == [("007", 1), ("1", 2), ("2", 0)]
    assert tables.stored(spark, path).columns == ["source", "thread_id", "n"]
    with pytest.raises(ValueError):
        commits.append_once(rows(spark), path, "a/b", KEYS)


@pytest.mark.parametrize("dies", ["data", "index"])
def test_a_run_killed_before_its_entry_in_the_log(spark, tmp_path, monkeypatch, dies):
    """Its rows are not read, hold nobody back, and are written over when it runs again."""
    path = str(tmp_path / "t")
    commits.append_once(rows(spark, ("a", "1", 1)), path, "1", KEYS, "n")
    new = rows(spark, ("a", "1", 5), ("a", "2", 5), ("b", "2", 5))

    class Killed:
        @property
        def get(self):
            raise KeyboardInterrupt

    if dies == "data":
        monkeypatch.setattr(commits.Observation, "get", Killed.get)
        with pytest.raises(KeyboardInterrupt):
            commits.append_once(new, path, "2", KEYS, "n")
        monkeypatch.undo()
    else:
        commits.append_once(new, path, "2", KEYS, "n")
        (log,) = (tmp_path / "t" / "log").glob("commit=c2")
        log.rename(tmp_path / "lost")  # as if the run had died just before the log
    assert held(spark, path) == [("a", "1", 1)]
    # Another run is not held back by the dead one ...
    assert commits.append_once(rows(spark, ("b", "2", 8)), path, "3", KEYS, "n") == 1
    # ... and the dead one, run again, adds only what is still new.
    assert commits.append_once(new, path, "2", KEYS, "n") == 1
    assert commits.append_once(new, path, "2", KEYS, "n") == 0
    assert held(spark, path) == [("a", "1", 1), ("a", "2", 5), ("b", "2", 8)]


def test_rows_that_lack_their_key_are_no_copies(spark, tmp_path):
    path = str(tmp_path / "t")
    some = rows(spark, ("a", None, 1), ("a", None, 2), (None, "1", 3), ("a", "1", 4))
    assert tables.append_new(some, path, KEYS, "n", partition_by=None)
    assert not tables.append_new(some, path, KEYS, "n", partition_by=None)
    assert not tables.append_new(some, path, KEYS, "n", partition_by=None)
    assert held(spark, path) == sorted(map(tuple, some.collect()), key=str)


def test_the_look_up_reads_touched_buckets_of_the_index_only(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        many = spark.range(k * 1000, k * 1000 + 1000).select(F.lit("a").alias("source"), F.col("id").cast("string").alias("thread_id"), F.lit(k).alias("n"))
        commits.append_once(many, path, str(k), KEYS, "n")
    batch = commits.with_digests(rows(spark, ("a", "5", 1), ("a", "5000", 1)), KEYS)
    touched = {r[0] for r in batch.select(commits._bucket(commits.BUCKETS)).collect()}
    known = commits.known_digests(batch, path, commits.BUCKETS)
    plan = plan_of(known)
    assert len(touched) <= 2 and "/data" not in plan
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    held_there = {r[0] for r in known.select(commits._bucket(commits.BUCKETS)).distinct().collect()}
    assert held_there == touched and known.count() < 600
    left = batch.join(known, ["_key1", "_key2"], "left_anti")
    assert [r.thread_id for r in left.collect()] == ["5000"]
    assert "Window" not in plan_of(left)


def test_compacted_copy(spark, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "u")
    commits.append_once(rows(spark, ("a", "1", 1), ("a", None, 1)), path, "1", KEYS, "n")
    commits.append_once(rows(spark, ("a", "2", 2), ("a", "1", 2)), path, "2", KEYS, "n")
    commits.compact(spark, path, out, buckets=7)
    assert held(spark, out) == held(spark, path)
    assert commits.append_once(rows(spark, ("a", "2", 5), ("a", "3", 5), ("a", None, 1)), out, "4", KEYS, "n") == 1
    assert commits.commits(spark, out).count() == 2


def test_stream_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    landing, sink, progress = (str(tmp_path / d) for d in ("landing", "sink", "progress"))
    rows(spark, ("a", "1", 1), ("a", "1", 2), ("b", "1", 1)).coalesce(1).write.json(landing)
    real = commits.commit_rows

    def dies(*args, **kw):
        real(*args, **kw)
        raise RuntimeError("killed")

    def drain():
        stream = streaming.landed(spark, landing, SCHEMA)
        streaming.collect(stream, sink, progress, KEYS, "n").awaitTermination()

    monkeypatch.setattr(commits, "commit_rows", dies)
    with pytest.raises(Exception, match="killed"):
        drain()
    monkeypatch.undo()
    drain()
    assert held(spark, sink) == [("a", "1", 1), ("b", "1", 1)]
    assert commits.commits(spark, sink).count() == 1  # the same commit, not one more
    rows(spark, ("a", "1", 9), ("c", "1", 9)).write.mode("append").json(landing)
    drain()
    assert held(spark, sink) == [("a", "1", 1), ("b", "1", 1), ("c", "1", 9)]

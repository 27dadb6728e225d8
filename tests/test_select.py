"""Filters, ranking, merging and ledgers on small tables with ties and copies."""

import datetime as dt
import random

import pytest
from support import plan_of
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions import scalars
from voxmill.operators import ledger, select

AS_OF = dt.datetime(2024, 7, 1)


def test_recent_keeps_the_edge(spark):
    edge = AS_OF - dt.timedelta(days=180)
    rows = spark.createDataFrame([(1, edge), (2, edge - dt.timedelta(seconds=1)), (3, AS_OF)], "i int, t timestamp")
    assert {r.i for r in select.recent(rows, "t", AS_OF).collect()} == {1, 3}


def test_open_and_pull_requests(spark):
    rows = spark.createDataFrame(
        [(1, "open", None), (2, "closed", None), (3, "open", "{}"), (4, None, None)],
        "i int, state string, pull_request string",
    )
    kept = select.without_pull_requests(select.open_only(rows))
    assert [r.i for r in kept.collect()] == [1]


def test_source_and_category(spark):
    rows = spark.createDataFrame([("GitHub", 5), ("Reddit", 7), ("Reddit", 9)], "source string, category_id int")
    assert select.of_source(rows).count() == 3
    assert select.of_source(rows, "Reddit").count() == 2
    assert select.in_categories(rows).count() == 2


def test_engagement(spark):
    row = spark.range(1).select(
        scalars.issue_engagement(F.lit(2), F.lit(3)),
        scalars.post_engagement(F.lit(-2), F.lit(3)),
        scalars.topic_engagement(F.lit(4), F.lit(19)),
        scalars.topic_engagement(F.lit(None).cast("int"), F.lit(None).cast("int")),
        scalars.topic_engagement(F.lit(0), F.lit(-7)),
        scalars.floor_divide(F.lit(-7), 2),
    )
    assert tuple(row.first()) == (5, 1, 5, 0, -1, -4)


def test_defaults(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ann",)], "a string")
    out = rows.select(scalars.post_author(F.col("a")), scalars.topic_author(F.col("a"))).collect()
    assert [tuple(r) for r in out] == [("[deleted]", "unknown"), ("[deleted]", ""), ("ann", "ann")]


def test_top_breaks_ties(spark):
    rows = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, 5)], "id int, s int")
    assert [r.id for r in select.top(rows, "s", 3, "id").collect()] == [2, 1, 3]
    assert "TakeOrderedAndProject" in plan_of(select.top(rows, "s", 3, "id"))


def test_merge_keeps_first_position_and_last_value(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "id string, v int, place int")
    b = spark.createDataFrame([("z", 3, 1), ("x", 4, 2)], "id string, v int, place int")
    merged = select.merge_candidates([a, b], "id").orderBy("first_place").collect()
    assert [(r.id, r.v) for r in merged] == [("x", 4), ("y", 2), ("z", 3)]


def test_keep_last_value_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", p, f"v{p}") for p in range(500)]
    expected = {}
    for key, pos, value in rows:
        expected[key] = (expected.get(key, (pos,))[0], pos, value)
    frame = spark.createDataFrame(rows, "k string, p bigint, v string").repartition(5)
    out = select.keep_last_value(frame, "k", "p").collect()
    assert {r.k: (r.first_position, r.p, r.v) for r in out} == expected and len(out) == len(expected)


@pytest.mark.parametrize("k", [5, 5000])
def test_top_per_group_with_a_hot_group(spark, k):
    """Whatever k, one plan; ties that are not unique give the same rows each time."""
    rng = random.Random(2)
    rows = [("hot" if i % 10 else f"g{i % 7}", i, rng.randint(0, 30)) for i in range(12_000)]
    frame = spark.createDataFrame(rows, "g string, id int, s int").repartition(6)
    best = select.top_per_group(frame, "g", "s", k, "id")
    plan = plan_of(best)
    expected = set()
    for group in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        expected |= {(group, i, p) for p, (_, i, _) in enumerate(members[:k], 1)}
    assert best.columns == ["g", "id", "s", "place"]
    assert {(r.g, r.id, r.place) for r in best.collect()} == expected
    assert "_part" in plan and plan.count("Window [") == 2
    # Up to Spark's own threshold groups are cut down before the shuffles as well.
    assert plan.count("WindowGroupLimit") >= 2 or k == 5000
    tied = [sorted(map(tuple, select.top_per_group(f, "g", "s", k).collect())) for f in (frame, frame.repartition(3, "id"))]
    assert tied[0] == tied[1]
    scores = {i: s for _, i, s in rows}
    assert sorted((g, s) for g, _, s, _ in tied[0]) == sorted((g, scores[i]) for g, i, _ in expected)


def test_first_per_key(spark):
    frame = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, o int")
    assert {tuple(r) for r in select.first_per_key(frame, ["k"], "o").collect()} == {("a", 1), ("b", 2)}


def test_concatenate_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "i int, x int"), spark.createDataFrame([(3, "q")], "i int, y string")
    assert {tuple(r) for r in select.concatenate([a, b]).collect()} == {(1, 2, None), (3, None, "q")}


def test_fetch_broadcasts_only_what_is_bounded(spark):
    wide = spark.range(1000).withColumn("t", F.lit("x"))
    winners = spark.range(3)
    assert "BroadcastHashJoin" in plan_of(select.fetch(wide, winners, "id"))  # small by its size
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(select.fetch(wide, winners, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ledger(spark):
    threads = spark.createDataFrame([("GitHub", "1"), ("Reddit", "1")], "source string, thread_id string")
    seen = ledger.ledger_of(threads)
    new = spark.createDataFrame([("GitHub", "1"), ("GitHub", "2"), ("Reddit", "2")], "source string, item_id string")
    left = ledger.not_in_ledger(new, seen, ["source", "item_id"])
    assert {tuple(r) for r in left.collect()} == {("GitHub", "2"), ("Reddit", "2")}


def test_dates(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00", "2024-01-02T05:04:05+02:00", "soon", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.orderBy("i").select(scalars.iso_text(scalars.parse_iso(F.col("t")))).collect()
    assert [r[0] for r in out] == ["2024-01-02T03:04:05+00:00"] * 3 + [None, None]
    moments = [F.lit(0), F.lit(1700000000.25), F.lit(-0.000001)]
    epochs = spark.range(1).select(*(scalars.iso_text(scalars.from_epoch(m)) for m in moments)).first()
    assert tuple(epochs) == tuple(
        (dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=m)).isoformat()
        for m in (0, 1700000000250000, -1)
    )


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        as_of = F.timestamp_seconds(F.lit(1_720_000_000))
        row = spark.range(1).select(
            scalars.iso_text(scalars.parse_iso(F.lit("2024-03-10T07:30:00Z"))),
            F.unix_seconds(scalars.cutoff(as_of)),
        )
        assert tuple(row.first()) == ("2024-03-10T07:30:00+00:00", 1_720_000_000 - 180 * 86_400)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_costs_are_exact(spark):
    row = spark.createDataFrame([(1_000_000, 500_000, "x" * 4003, 25)], "i bigint, o bigint, p string, n bigint").select(
        scalars.token_cost(F.col("i"), F.col("o")).cast("double"),
        scalars.estimate_tokens(F.col("p")),
        scalars.estimate_batch_cost(F.col("p"), F.col("n")).cast("double"),
    )
    assert tuple(row.first()) == (9.0, 1000, 0.018)
    assert (vocab.BATCH_SIZE, vocab.RECENT_DAYS) == (25, 180)


def test_json_keeps_unicode(spark):
    rows = spark.createDataFrame([("é𝄞",)], "t string")
    assert rows.select(scalars.to_document("t")).first()[0] == '{"t":"é𝄞"}'

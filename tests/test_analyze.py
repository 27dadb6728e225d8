"""Aggregates against counts made by hand, and the shape of their plans."""

import random
from collections import Counter

import pytest
from support import plan_of

from voxmill.operators import analyze, report

SCHEMA = "kind string, category string, sentiment string, priority string, source string, user_type string, confidence string, position bigint"
PRIORITIES = ("high", "medium", "low", "High", "none")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [
        (
            rng.choice(("pain_points", "feature_requests")),
            "hot" if rng.random() < 0.4 else f"c{rng.randint(0, 7)}",
            rng.choice("ab"),
            rng.choice(PRIORITIES),
            rng.choice("xyz"),
            rng.choice("uv"),
            rng.choice(("High", "Medium", "Low")),
            position,
        )
        for position in range(600)
    ]


@pytest.fixture(scope="module")
def counts(spark, rows):
    return analyze.item_counts(spark.createDataFrame(rows, SCHEMA).repartition(7), position="position")


def test_crosstab_totals(rows, counts):
    expected = Counter((r[0], dim, r[1], r[2 + i]) for r in rows for i, dim in enumerate(analyze.DIMENSIONS))
    got = {(r.kind, r["dim"], r.category, r.value): r.n for r in analyze.crosstab(counts).collect()}
    assert got == expected


def test_counts(rows, counts):
    assert {(r.kind, r.category): r.n for r in analyze.category_counts(counts).collect()} == Counter(r[:2] for r in rows)
    assert {r.kind: r.total_items for r in analyze.totals(counts).collect()} == Counter(r[0] for r in rows)
    assert {r.categories for r in analyze.distinct_categories(counts).collect()} == {9}
    assert analyze.totals(counts.where("false")).count() == 0


def test_top_categories_break_ties_by_first_sight(spark):
    rows = [("pain_points", c, *"abcde", p) for p, c in enumerate("zaybzaybx")]
    counts = analyze.item_counts(spark.createDataFrame(rows, SCHEMA), position="position")
    assert [(r.category, r.n) for r in report.pain_point_bars(counts).collect()] == [
        ("z", 2), ("a", 2), ("y", 2), ("b", 2), ("x", 1),
    ]
    assert [r.category for r in report.pain_point_bars(counts, 2).collect()] == ["z", "a"]


def test_matrix(rows, counts):
    score = {"high": 3, "medium": 2, "low": 1}
    pains = [r for r in rows if r[0] == "pain_points"]
    frequency = Counter(r[1] for r in pains)
    total = Counter()
    for r in pains:
        total[r[1]] += score.get(r[3], 0)
    often = sum(frequency.values()) / len(frequency)
    severe = sum(total[c] / frequency[c] for c in frequency) / len(frequency)
    matrix = report.priority_matrix(counts).collect()
    assert {r.category for r in matrix} == set(frequency)
    for r in matrix:
        assert (r.frequency, r.total_priority) == (frequency[r.category], total[r.category])
        impact = "High" if total[r.category] / frequency[r.category] >= severe else "Low"
        assert r.quadrant == f"{impact} Impact / {'High' if frequency[r.category] >= often else 'Low'} Frequency"


def test_matrix_of_one_and_of_none(spark):
    one = analyze.item_counts(spark.createDataFrame([("pain_points", "c", *"ab", *"cde", 1)], SCHEMA))
    assert [r.quadrant for r in report.priority_matrix(one).collect()] == ["High Impact / High Frequency"]
    assert report.priority_matrix(one.where("false")).collect() == []


def test_equal_impacts_stay_on_the_line(spark):
    """Sevenths do not add up exactly; equal categories must not fall below their mean."""
    rows = []
    for c in "abcdefghij":
        rows += [("pain_points", c, "s", p, "x", "u", "High", 0) for p in ["high"] * 2 + ["low"] * 5]
    counts = analyze.item_counts(spark.createDataFrame(rows, SCHEMA))
    assert {r.quadrant for r in report.priority_matrix(counts).collect()} == {"High Impact / High Frequency"}


def test_roadmap_order(counts):
    rank = ["High Impact / High Frequency", "High Impact / Low Frequency", "Low Impact / Low Frequency", "Low Impact / High Frequency"]
    plan = report.roadmap(counts).collect()
    keys = [(rank.index(r.quadrant), -round(r.impact, 9), -r.frequency) for r in plan]
    assert keys == sorted(keys)


def test_shares(rows, counts):
    shares = {r.kind: r.high_confidence_share for r in analyze.high_confidence_share(counts).collect()}
    for kind, share in shares.items():
        members = [r for r in rows if r[0] == kind]
        assert share == sum(r[6] == "High" for r in members) / len(members)
    for r in analyze.high_priority_share(counts).collect():
        members = [x for x in rows if x[:2] == (r.kind, r.category)]
        assert r.high_priority_share == sum(x[3] == "high" for x in members) / len(members)


def test_themes_and_counters(spark):
    items = spark.createDataFrame([("p", "Multi-Window bug"), ("p", "x"), ("f", "window"), ("f", None)], "kind string, text string")
    out = {r.kind: (r["items"], r.mentions) for r in analyze.theme_mentions(items, ("multi-window", "multiwindow")).collect()}
    assert out == {"p": (2, 1), "f": (2, 0)}
    threads = spark.createDataFrame([(["a"], None), ([], ["b", "c"])], "pain_points array<string>, feature_requests array<string>")
    assert tuple(analyze.run_counters(threads).first()) == (2, 1, 2)
    assert tuple(analyze.run_counters(threads.where("false")).first()) == (0, 0, 0)


def test_counts_are_combined_before_the_shuffle(counts):
    for table in (analyze.crosstab(counts), analyze.distributions(counts), report.pain_point_bars(counts)):
        plan = plan_of(table)
        assert "SortAggregate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "partial_count" in plan


def test_matrix_shuffles_the_items_once(spark, rows):
    items = spark.createDataFrame(rows, SCHEMA)
    matrix = report.priority_matrix(analyze.item_counts(items, ("priority",)))
    matrix.collect()
    assert "ReusedExchange" in plan_of(matrix)  # the means and the rows come from one shuffle


def test_missing_attribute_values_are_counted(spark):
    rows = [("pain_points", "c", None, "high", "x", "u", "High", 1), ("pain_points", "c", "s", None, "x", "u", "High", 2)]
    counts = analyze.item_counts(spark.createDataFrame(rows, SCHEMA))
    assert {(r["dim"], r.value): r.n for r in analyze.distributions(counts).collect()} == {
        ("sentiment", None): 1, ("sentiment", "s"): 1, ("priority", "high"): 1, ("priority", None): 1,
        ("source", "x"): 2, ("user_type", "u"): 2, ("confidence", "High"): 2,
    }
    assert analyze.totals(counts).first().total_items == 2

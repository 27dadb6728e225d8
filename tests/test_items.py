"""Items, dense numbering, batches and prompts."""

import random

import pytest
from support import plan_of
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.operators import items
from voxmill.operators.numbering import running_sums, sums_before

SCHEMA = (
    "pos bigint, thread_id string, source string, sentiment string, priority string, user_type string,"
    " pain_points array<string>, feature_requests array<string>"
)


def threads(spark, sizes, positions=None):
    rows = []
    for i, (pain, request) in enumerate(sizes):
        texts = [None if n is None else [f"t{i}-{j}" for j in range(n)] for n in (pain, request)]
        at = positions[i] if positions else i
        rows.append((at, str(i), "GitHub", "negative", "high", "dev", *texts))
    return spark.createDataFrame(rows, SCHEMA)


def test_explode_order_and_ids(spark):
    out = items.explode_items(threads(spark, [(2, 1), (None, None), (0, 2)]), "pos").orderBy("item_pos", "kind")
    assert [(r.item_id, r.text) for r in out.collect()] == [
        ("GitHub:0:feature_requests:0", "t0-0"),
        ("GitHub:0:pain_points:0", "t0-0"),
        ("GitHub:0:pain_points:1", "t0-1"),
        ("GitHub:2:feature_requests:0", "t2-0"),
        ("GitHub:2:feature_requests:1", "t2-1"),
    ]
    assert "Exchange" not in plan_of(items.explode_items(threads(spark, [(1, 1)]), "pos"))


@pytest.mark.parametrize("spread", [1, 1000, 2**13, 2**30, 2**47])
def test_sums_before(spark, spread):
    rng = random.Random(spread)
    positions = rng.sample(range(0, 300 * spread, spread), 200)
    rows = [(g, p, rng.randint(0, 9)) for g in ("a", "b") for p in positions]
    frame = spark.createDataFrame(rows, "g string, p bigint, w bigint").repartition(5)
    out = sums_before(frame, "p", {"before": F.col("w"), "rank": F.lit(1)}, by=["g"])
    expected = {}
    for group in ("a", "b"):
        total = 0
        for rank, (_, p, w) in enumerate(sorted(r for r in rows if r[0] == group)):
            expected[group, p] = (total, rank)
            total += w
    rows_ = out.collect()
    assert {(r.g, r.p): (r.before, r["rank"]) for r in rows_} == expected and len(rows_) == 400
    for group in ("a", "b"):
        total = sum(r[2] for r in rows if r[0] == group)
        assert {(r.before_total, r.rank_total) for r in rows_ if r.g == group} == {(total, 200)}


def test_sums_before_of_hashed_positions(spark):
    """62-bit hashes as positions, one group with nearly all rows; ranges split it."""
    rng = random.Random(62)
    rows = [("hot" if k % 50 else f"g{k}", rng.getrandbits(62), rng.randint(0, 9), "wide " * 3) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, p bigint, w bigint, body string").repartition(7)
    out = sums_before(frame, "p", {"before": F.col("w"), "rank": F.lit(1)}, by=["g"])
    want, sums = {}, {}
    for g, p, w, _ in sorted(rows):
        total, rank = sums.get(g, (0, 0))
        want[g, p] = (total, rank)
        sums[g] = (total + w, rank + 1)
    got = out.collect()
    assert {(r.g, r.p): (r.before, r["rank"]) for r in got} == want and len(got) == 3000
    assert {(r.g, r.before_total, r.rank_total) for r in got} == {(g, *t) for g, t in sums.items()}


def test_only_range_totals_meet_in_one_task(spark, tmp_path, capsys):
    """No group: the rows are windowed by range, and the wide column stays where it is."""
    frame = spark.range(20_000).select(F.xxhash64("id").bitwiseAND(F.lit(2**62 - 1)).alias("p"), F.repeat(F.lit("x"), 200).alias("body"))
    frame.repartition(8).write.parquet(f"{tmp_path}/wide")
    out = sums_before(spark.read.parquet(f"{tmp_path}/wide"), "p", {"rank": F.lit(1)})
    plan = plan_of(out)
    single = plan.index("Exchange SinglePartition")
    assert plan.count("Exchange SinglePartition") == 1
    assert plan[single:].lstrip().split("\n")[1].strip(" +-:*()0123456789").startswith("HashAggregate")
    assert "BroadcastHashJoin" in plan and "body" not in "".join(line for line in plan.split("\n") if "Exchange" in line)
    ranks = [r[0] for r in out.orderBy("p").select("rank").collect()]
    assert ranks == list(range(20_000))


def test_running_sums_of_ties_and_nulls(spark):
    frame = spark.createDataFrame([(None, 1, 2), (None, 1, 2), (None, None, 5), ("a", 3, 1)], "g string, p int, w bigint")
    out = running_sums(frame, ["p"], {"before": F.col("w")}, ["g"])
    assert sorted(map(str, out.collect())) == sorted([
        "Row(g=None, p=None, w=5, before=0, before_total=9)", "Row(g=None, p=1, w=2, before=5, before_total=9)",
        "Row(g=None, p=1, w=2, before=7, before_total=9)", "Row(g='a', p=3, w=1, before=0, before_total=1)",
    ])
    assert running_sums(frame.limit(0), ["p"], {"before": F.col("w")}, ["g"]).count() == 0


@pytest.mark.parametrize("sizes", [[(25, 26)], [(1, 0), (24, 51), (None, 1), (30, None)], [(0, 0)]])
def test_batches(spark, sizes):
    positions = [7 * 2**40 - 2**13 * i for i in range(len(sizes))]  # backwards and far apart
    out = items.batched_items(threads(spark, sizes, positions), "pos").collect()
    for kind, column in zip(vocab.KINDS, (0, 1)):
        expected = [(str(i), j) for i, s in reversed(list(enumerate(sizes))) for j in range(s[column] or 0)]
        got = sorted((r for r in out if r.kind == kind), key=lambda r: r.item_index)
        assert [(r.thread_id, r.list_pos) for r in got] == expected
        assert [r.item_index for r in got] == list(range(len(got)))
        assert [(r.batch_num, r.pos_in_batch) for r in got] == [(n // 25 + 1, n % 25) for n in range(len(got))]
        assert {r.total_batches for r in got} <= {-(-len(got) // 25)}


def test_prompt(spark):
    batched = items.batched_items(threads(spark, [(26, 1)]), "pos")
    out = {(r.kind, r.batch_num): r for r in items.prompts(batched, "Acme note-taking").collect()}
    assert {k: r.n_items for k, r in out.items()} == {
        ("pain_points", 1): 25,
        ("pain_points", 2): 1,
        ("feature_requests", 1): 1,
    }
    lines = out["feature_requests", 1].prompt.split("\n")
    assert lines[:2] == [
        "You are analyzing user feedback for the Acme note-taking application. ",
        "Please categorize the following feature requests into the most appropriate categories.",
    ]
    assert lines[3:6] == ["Available categories for feature_requests:", "- Editor Enhancements", "- Mobile Features"]
    at = lines.index("Items to categorize:")
    assert lines[at - 2 : at + 3] == ["- Other", "", "Items to categorize:", "1. t0-0", ""]
    assert lines[-1] == "Ensure the response is valid JSON without markdown formatting."
    assert "\n25. t0-24\n" in out["pain_points", 1].prompt


def test_comment_pages_are_bounded(spark):
    rows = [("hot", i, f"b{i}") for i in range(120)] + [("cold", 0, "c")]
    frame = spark.createDataFrame(rows, "thread_id string, pos bigint, body string").repartition(4)
    pages = items.comment_pages(frame, 50).orderBy("thread_id", "page").collect()
    assert [(p.thread_id, p.page, len(p.comments)) for p in pages] == [
        ("cold", 0, 1), ("hot", 0, 50), ("hot", 1, 50), ("hot", 2, 20),
    ]
    assert [c.body for p in pages if p.thread_id == "hot" for c in p.comments] == [f"b{i}" for i in range(120)]


def test_ids_of_different_places_differ(spark):
    from voxmill.operators.items import explode_items

    rows = [("a", "b:c"), ("a:b", "c"), (None, "a"), ("a", None), ("\\N", "a"), ("a\\", ":c"), ("a:", "c")]
    threads = spark.createDataFrame([(*r, ["x"], ["y"]) for r in rows], "source string, thread_id string, pain_points array<string>, feature_requests array<string>")
    ids = [r.item_id for r in explode_items(threads).collect()]
    assert len(set(ids)) == len(ids) == 14


def test_text_behind_an_array_is_no_reply(spark):
    from pyspark.sql import functions as F

    from voxmill.operators.replies import parse_reply

    one = '[{"text": "t", "category": "c", "confidence": "High", "reasoning": "r"}]'
    rows = spark.createDataFrame([(one,), (one + " thanks, done",), (one + " \n",)], "reply string")
    assert [r[0] for r in rows.select(F.size(parse_reply(F.col("reply")))).collect()] in ([1, -1, 1], [1, None, 1])


def test_words_of_other_languages_stay_whole(spark):
    from pyspark.sql import functions as F

    from voxmill.operators.classify import words

    assert spark.range(1).select(words(F.lit("größe señor Ошибка x1"))).first()[0] == ["größe", "señor", "ошибка", "x1"]

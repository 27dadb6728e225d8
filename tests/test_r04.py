"""What a reviewer found in the fourth round."""

import random
from pathlib import Path

import numpy as np

from pyspark.sql import functions as F

from tests.llm import brute
from voxmill.llm import shingle_join
from voxmill.session import shared_root


def stored_names(spark):
    return {f.name for f in Path(shared_root(spark).removeprefix("file:")).iterdir()}


def test_sketches_tell_long_sets_apart_and_lose_no_link(spark):
    rng = np.random.default_rng(1)
    rows, wanted = [], []
    for n in (1, 40, 500, 512, 513, 900, 1000, 1024, 1100, 2000, 2048, 3000, 9000):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        more = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        near = np.sort(np.concatenate([own, more[: len(own) // 4]]))  # 4 / 5 in common, of other length and often longer sketch
        for x, y, link in ((own, near, True), (near, own, True), (own, own, True), (own, more, n == 1), (own, np.sort(np.concatenate([own[: n // 2], more[n // 2 :]])), n == 1)):
            rows.append((len(wanted), len(x), shingle_join.sketch(x).tolist(), len(y), shingle_join.sketch(y).tolist()))
            wanted.append(link if n > 1 else None)
            assert not link or n == 1 or shingle_join.same_share(x, y, 80, 100)
    sets = spark.createDataFrame(rows, "k int, n int, s array<bigint>, m int, t array<bigint>")
    x, y = F.struct("n", F.col("s").alias("sketch")).alias("x"), F.struct(F.col("m").alias("n"), F.col("t").alias("sketch")).alias("y")
    pairs = sets.select("k", x, y).select("k", shingle_join._may_link(F.col("x"), F.col("y"), 80, 100).alias("may"))
    assert all(r.may == wanted[r.k] for r in pairs.collect() if wanted[r.k] is not None)


def test_long_texts_with_a_passage_in_common_are_not_moved_or_checked(spark, monkeypatch):
    rng, asked = random.Random(2), []
    passage = [f"p{k}" for k in range(300)]
    texts = [" ".join([*(f"{rng.randrange(10**6)}" for _ in range(1300)), *passage]) for _ in range(8)]
    words = texts[0].split()
    texts += [" ".join(w if k % 100 else "q" for k, w in enumerate(words)), None, " ".join(words[:1500])]
    linked = shingle_join._linked

    def spy(pairs, *more):
        asked.extend((p.a, p.b) for p in pairs.collect())
        return linked(pairs, *more)

    monkeypatch.setattr(shingle_join, "_linked", spy)
    found = shingle_join.join_shingles(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute.shingle_join(list(enumerate(texts)), 5, 80, 100)
    assert {i for i, (_, c) in got.items() if c == 0} == {0, 8, 10}
    assert asked and set(asked) <= {(8, 0), (10, 0), (10, 8)}


def test_pairs_that_outweigh_their_texts_are_checked_in_turns(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(9)}" for w in words) for _ in range(24)]
    rows = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (3, texts[4]), (99, "in no pair")], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(24) for b in range(a)], "a bigint, b bigint")
    before = stored_names(spark)
    links = shingle_join._linked(pairs, rows, 3, 80, 100)
    assert len(links) > 5 and {n.split("-")[0] for n in stored_names(spark) - before} == {"links"}
    own = {k: [shingle_join.shingles(t, 3)] for k, t in enumerate(texts)}
    own[3] += own[4]
    wanted = {(a, b) for a in own for b in range(a) for x in own[a] for y in own[b] if shingle_join.same_share(x, y, 80, 100)}
    assert 0 < len(wanted) < 276 and {(r.a, r.b) for part in links for r in part.collect()} == wanted
    none = shingle_join._linked(pairs.limit(0), rows, 3, 80, 100)
    assert len(none) == 1 and none[0].count() == 0

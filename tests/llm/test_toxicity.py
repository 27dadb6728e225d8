"""The noisy-or model: its gradient steps, its scores, what it finds."""

import math
import random
import zlib

import numpy as np
import pytest

from voxmill.llm import queries, toxicity

rng = random.Random(3)
CALM = [f"word{k}" for k in range(300)]
BAD = ["vilest", "vilely", "scumbag", "ghoulish"]


def sentence(bad=False):
    own = rng.choices(CALM, k=rng.randint(4, 9))
    if bad:
        own.insert(rng.randrange(len(own)), rng.choice(BAD).title() + rng.choice(["", ","]))
    return " ".join(own) + rng.choice([".", "!", "\n"])


def document(bad):
    own = [sentence() for _ in range(rng.randint(1, 12))]
    if bad:
        own.insert(rng.randrange(len(own) + 1), sentence(True))
    return " ".join(own)


def table(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, None, "x") for i, t in texts], "doc_id bigint, text string, score double, toxic int, tkey string")


def labels(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, toxic int, text int")


@pytest.fixture(scope="module")
def corpus():
    return [(k, document(k % 4 == 0)) for k in range(600)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    said = [(k, int(k % 4 == 0)) for k, _ in corpus if k < 400]
    return toxicity.learn(table(spark, corpus), labels(spark, [*said, (3, None), (None, 1), (9999, 1), (5, 0)]))


def plain(text, model):
    """Score and offending sentences, stated anew."""
    quiet, found = 1.0, []
    start = 0
    for k, c in enumerate(text + "."):
        if c not in ".!?\n":
            continue
        own = text[start:k]
        if own.split():
            z = model.bias + sum(model.weights.get(f, 0.0) for w in own.split() for f in toxicity.word_features(w))
            p = 1 / (1 + math.exp(-z))
            quiet *= 1 - p
            if p >= 0.5:
                found.append((start, k))
        start = k + 1
    return 1 - quiet, found


def test_scores_are_the_noisy_or_of_sentences(spark, corpus, model):
    odd = [(1000, None), (1001, ""), (1002, " \n\t.!?"), (1003, "x" * 100_000), (1004, (corpus[1][1] + " ") * 300), (None, "vilest İ"), (4, corpus[4][1])]
    rows = toxicity.score(table(spark, corpus + odd), model).collect()
    assert len(rows) == len(corpus + odd)
    texts = dict(corpus) | dict(odd)
    for r in rows:
        total, found = plain(texts[r.doc_id] or "", model)
        assert r.score == pytest.approx(total, abs=1e-9) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
        assert [(s.lo, s.hi) for s in r.sentences] == found
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[1000] == by_id[1001] == by_id[1002] == 0


def test_held_out_documents_and_sentences(spark, corpus, model):
    rows = [r for r in toxicity.score(table(spark, corpus), model).collect() if r.doc_id >= 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in rows) >= 0.97 * len(rows)
    texts = dict(corpus)
    cut = [texts[r.doc_id][s.lo : s.hi].lower() for r in rows for s in r.sentences]
    assert len(cut) >= 45 and sum(any(b in c for b in BAD) for c in cut) >= 0.95 * len(cut)


def test_gradient_steps_go_downhill():
    """The fit beats its start and every small step away from it."""
    r = np.random.default_rng(1)
    sizes = r.integers(1, 5, 40)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sentence_of = np.repeat(np.arange(starts[-1]), 2)
    feature = r.integers(0, 6, len(sentence_of))
    bare = r.integers(0, 4, 40).astype(float)
    toxic = np.array([any(f == 0 for f, s in zip(feature, sentence_of) if a <= s < b) for a, b in zip(starts, starts[1:])])
    toxic[:3] = ~toxic[:3]
    weight = np.ones(40)

    def loss(w, b):
        z = np.bincount(sentence_of, w[feature], starts[-1]) + b
        total = np.array([toxicity.softplus(z[i:j]).sum() for i, j in zip(starts, starts[1:])]) + bare * toxicity.softplus(b)
        return np.where(toxic, -np.log(-np.expm1(-total)), total).mean() + toxicity.SHRINK * (w**2).sum() / 2

    w, b = toxicity.fit(starts, feature, sentence_of, bare, toxic, weight, 6)
    best = loss(w, b)
    assert best < loss(np.zeros(6), math.log(0.1 / (sizes + bare).mean())) - 0.1
    for k in range(6):
        for step in (-0.3, 0.3):
            away = w.copy()
            away[k] += step
            assert loss(away, b) > best - 1e-3
    assert loss(w, b + 0.3) > best - 1e-3 and loss(w, b - 0.3) > best - 1e-3


def test_nothing_to_learn_from(spark, corpus):
    docs = table(spark, corpus[:20])
    for said in ([], [(1, 0), (2, 0)], [(4, None)]):
        model = toxicity.learn(docs, labels(spark, said))
        assert model == ({}, None)
        assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    model = toxicity.learn(table(spark, [(0, ""), (1, None)]), labels(spark, [(0, 1), (1, 0)]))
    assert model.weights == {} and toxicity.score(table(spark, []), model).count() == 0


def test_sample_is_bounded_and_the_same_each_time(spark, corpus):
    said = labels(spark, [(k, int(k % 4 == 0)) for k, _ in corpus])
    sample, totals = toxicity._sample(table(spark, corpus).repartition(7), said, 30, "doc_id", "text")
    other, _ = toxicity._sample(table(spark, corpus).repartition(2), said, 30, "doc_id", "text")
    assert totals == {0: 450, 1: 150} and sample.count() == 60
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, other.collect()))


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_toxicity(spark, sf).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    caught = [p for t, p in judged if t == 1]
    assert len(caught) > 40 and sum(caught) >= 0.9 * len(caught)  # some are labelled toxic without a toxic word
    assert sum(p for t, p in judged if t == 0) <= 0.01 * len(judged)

"""Toxic documents and the sentences that make them so: multiple-instance learning."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from string import punctuation
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import text_key
from voxmill.session import stored_once

#: Labelled documents of each class that a model is fitted on, at most.
PER_CLASS = 4000
#: Features of a model, and documents of the sample that a feature must come in.
FEATURES, LEAST_DOCS = 2000, 5
#: Lengths of the character strings inside a word that are features beside the word itself.
GRAMS = (4, 5)
STEPS, RATE, SHRINK = 300, 0.1, 3e-5
#: Words remembered per worker, and different features a worker holds before handing on.
WORDS_KEPT, FEATURES_HELD = 500_000, 1_000_000

SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = punctuation + "¡¿«»“”„‘’…–—"


class Model(NamedTuple):
    """Weights by feature, the bias of a sentence; no bias where nothing could be learned."""

    weights: dict[str, float]
    bias: float | None


def word_features(word: str) -> list[str]:
    """The word in lower case, and its pieces, marked where it begins and ends."""
    word = word.lower().strip(_EDGES)
    if not word:
        return []
    whole = f"^{word}$"
    return [whole, *{whole[k : k + n] for n in GRAMS for k in range(len(whole) - n + 1)} - {whole}]


class _Words(dict):
    """word -> what ``value`` makes of its features, computed once per word."""

    def __init__(self, value) -> None:
        self.value = value

    def __missing__(self, word: str):
        found = self.value(word_features(word))
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found
        return found


def softplus(z):
    return np.logaddexp(0.0, z)


def fit(starts: np.ndarray, feature: np.ndarray, sentence: np.ndarray, bare: np.ndarray, toxic: np.ndarray, weight: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likeliest.

    A sentence with logit z offends with chance 1/(1+e^-z); a document is toxic if any of
    its sentences offends (noisy-or), so its chance is 1 - exp(-A), A = sum of log(1+e^z).
    ``feature[i]`` occurs in ``sentence[i]``; sentences of document d are starts[d] to
    starts[d+1], and ``bare[d]`` more of them have no feature at all. Full gradient steps
    (Adam) on the weighted likelihood with a little shrinkage: the result is always the same.
    """
    n_sentences = int(starts[-1])
    of = np.repeat(np.arange(len(toxic)), np.diff(starts))
    lengths = np.maximum(1.0, bare + np.diff(starts))
    theta = np.zeros(n_features + 1)
    theta[-1] = math.log(0.1 / lengths.mean())
    slope, square = np.zeros_like(theta), np.zeros_like(theta)
    share = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, theta[feature], n_sentences) + theta[-1]
        total = np.bincount(of, softplus(z), len(toxic)) + bare * softplus(theta[-1])
        pull = share * np.where(toxic, -1.0 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)
        chance = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        by_sentence = pull[of] * chance
        gradient = np.empty_like(theta)
        gradient[:-1] = np.bincount(feature, by_sentence[sentence], n_features) + SHRINK * theta[:-1]
        gradient[-1] = by_sentence.sum() + (pull * bare).sum() / (1.0 + math.exp(-theta[-1]))
        slope += 0.1 * (gradient - slope)
        square += 0.01 * (gradient**2 - square)
        theta -= RATE * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that have it: clean, toxic)."""
    words = _Words(tuple)
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def handed_on() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            own: set[str] = set()
            for word in {w for s in SENTENCE.findall(text.as_py()) for w in s.split()}:
                own.update(words[word])
            counts[toxic.as_py()].update(own)
            if max(map(len, counts)) >= FEATURES_HELD:
                yield handed_on()
    yield handed_on()


def _encoder(places: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(lambda own: [places[f] for f in own if f in places])
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in zip(batch.column(0), batch.column(1)):
                found, sizes, bare = [], [], 0
                for s in SENTENCE.findall(text.as_py()):
                    own = [p for w in s.split() for p in words[w]]
                    if own:
                        found += own
                        sizes.append(len(own))
                    elif not s.isspace():
                        bare += 1
                out.append((toxic.as_py(), found, sizes, bare))
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, kinds)], names=["toxic", "found", "sizes", "bare"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most ``per_class`` labelled documents of each class, those whose
    key hashes lowest, and how many there are of each class in all. Ids are ranked without
    their texts; a document with several labels is toxic if one of them says so."""
    said = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("tkey"))
    rows = stored_once(keyed.select("doc_id", "tkey").join(said, "doc_id").withColumn("place", F.xxhash64("doc_id", "tkey")), "labelled")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [rows.filter(F.col("toxic") == c).orderBy("place", "doc_id", "tkey").limit(per_class) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).groupBy("doc_id", "tkey").agg(F.max("toxic").alias("toxic"))
    return stored_once(keyed.join(chosen, ["doc_id", "tkey"]).select("text", "toxic"), "sample"), totals


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from document labels (id, ``toxic`` 0 or 1).

    Features are the words and word pieces whose share of toxic and of clean documents
    differs most (G statistic), counted in Spark tasks over a sample of at most ``per_class`` documents
    of each class. Only the chosen features' places in the sample's sentences come to the
    driver, where ``fit`` runs: its size depends on the bounds, not on the corpus. Both
    classes weigh alike. Without labels of both classes there is no model.
    """
    sample, totals = _sample(docs, labels, per_class, id_col, text_col)
    if len(totals) < 2:
        return Model({}, None)
    counted = sample.mapInArrow(_document_counts, "feature string, clean bigint, toxic bigint")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {c: min(k, per_class) for c, k in totals.items()}
    both = n[0] + n[1]
    seen = F.col("clean") + F.col("toxic")

    def term(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    g = sum(
        term(F.col(c), seen * n[k] / both) + term(n[k] - F.col(c), (both - seen) * n[k] / both) for k, c in ((0, "clean"), (1, "toxic"))
    )
    best = counted.filter(seen >= LEAST_DOCS).select("feature", F.round(g, 6).alias("g")).orderBy(F.desc("g"), "feature").limit(n_features)
    names = [r["feature"] for r in best.collect()]
    rows = sample.mapInArrow(_encoder({f: k for k, f in enumerate(names)}), "toxic int, found array<int>, sizes array<int>, bare bigint")
    rows = sorted((tuple(r) for r in rows.collect()))
    toxic = np.array([r[0] for r in rows], bool)
    sizes = [np.array(r[2], np.int64) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    feature = np.concatenate([np.array(r[1], np.int64) for r in rows])
    sentence = np.repeat(np.arange(int(starts[-1])), np.concatenate(sizes))
    weight = np.where(toxic, 1 / max(1, toxic.sum()), 1 / max(1, (~toxic).sum()))
    w, bias = fit(starts, feature, sentence, np.array([r[3] for r in rows], float), toxic, weight, len(names))
    return Model({f: float(x) for f, x in zip(names, w)}, bias)


def score_text(text: str, words: _Words, bias: float, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """(chance that the text is toxic, its sentences (from, to, chance) from ``least`` on)."""
    total, found, bare = 0.0, [], 0
    for match in SENTENCE.finditer(text):
        own = match.group().split()
        if not own:
            continue
        z = sum(map(words.__getitem__, own))
        if z == 0.0:
            bare += 1
            continue
        z += bias
        total += math.log1p(math.exp(z)) if z < 30 else z
        chance = 1.0 / (1.0 + math.exp(-z)) if z > -500 else 0.0
        if chance >= least:
            found.append((match.start(), match.end(), chance))
    total += bare * math.log1p(math.exp(bias))
    return -math.expm1(-total), found


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, score, predicted, sentences) of every row of ``docs``, in one pass.

    ``score`` is the noisy-or of all sentences of the whole text, ``predicted`` 1 from 0.5
    on; ``sentences`` has those that offend with a chance of 0.5 or more: (lo, hi, chance), in
    characters of the text. Sentences end at ``.!?`` and line ends. Null, empty and blank
    texts have no sentence and score 0, as does everything without a model. Repeated rows are
    scored alike; other columns of ``docs`` are not looked at.
    """
    spans = "array<struct<lo: bigint, hi: bigint, chance: double>>"
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, tkey bigint, score double, predicted int, sentences {spans}"
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("chance", pa.float64())]))
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(lambda own: sum(weights.get(f, 0.0) for f in own))
        for batch in batches:
            scores, sentences = [], []
            for text in batch.column(2):
                total, found = (0.0, []) if bias is None else score_text(text.as_py(), words, bias)
                scores.append(total)
                sentences.append([dict(zip(("lo", "hi", "chance"), f)) for f in found])
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(sentences, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "score", "predicted", "sentences"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def held_out(ident: Column, parts: int = 5) -> Column:
    """Whether a document is kept from learning: one part of ``parts``, by a checksum of its
    id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % parts == 0

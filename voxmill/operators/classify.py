"""Categorising items: built-in lexicon, user callables, checks on the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill import vocab

Lexicon = Mapping[str, Mapping[str, Sequence[str]]]
Answer = Mapping[str, str | int]
Classifier = Callable[[list[str], str], Iterable[Answer]]

ANSWERED, MISMATCHED, UNANSWERED, SURPLUS = "answered", "mismatched", "unanswered", "surplus"
ACCEPTED, QUARANTINED, PENDING = "accepted", "quarantine", "pending"


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)


def _isin(value: Column, options: Iterable[str]) -> Column:
    return value.isin(list(options))


def count_words(tokens: Column, options: Iterable[str]) -> Column:
    options = list(options)
    return F.size(F.filter(tokens, lambda w: _isin(w, options)))


# -- built-in classifier (CAT4) ---------------------------------------------


def classify_by_lexicon(items: DataFrame, lexicon: Lexicon = vocab.LEXICON) -> DataFrame:
    """Category with the most lexicon words; ties by vocabulary order, none is "Other".

    Works within the row: no explode, no shuffle, no Python. The text is cut into words
    once and reduced to the few that any category knows before they are counted. The words
    become part of the plan; a lexicon that is a table is for ``classify_by_lexicon_table``.
    """
    known = {w for categories in lexicon.values() for ws in categories.values() for w in ws}

    def scored(kind: str) -> Column:
        order = {c: i for i, c in enumerate(vocab.VOCABULARY[kind])}
        entries = [
            F.struct(
                count_words(F.col("_hits"), ws).alias("score"),
                F.lit(-order.get(c, len(order))).alias("order"),
                F.lit(c).alias("category"),
            )
            for c, ws in lexicon[kind].items()
        ]
        return F.array_max(F.array(*entries))

    pain, request = vocab.KINDS
    best = items.withColumn("_hits", F.filter(words(F.col("text")), lambda w: _isin(w, known))).withColumn(
        "_best", F.when(F.col("kind") == pain, scored(pain)).otherwise(scored(request))
    )
    score = F.col("_best.score")
    return best.select(
        *items.columns,
        F.when(score > 0, F.col("_best.category")).otherwise(vocab.OTHER).alias("category"),
        F.when(score >= 3, "High").when(score == 2, "Medium").otherwise("Low").alias("confidence"),
        F.concat(score.cast("string"), F.lit(" lexicon words")).alias("reasoning"),
    )


def lexicon_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """A lexicon as a table (kind, category, word)."""
    rows = [(kind, category, word) for kind, categories in lexicon.items() for category, ws in categories.items() for word in ws]
    return spark.createDataFrame(rows, "kind string, category string, word string")


def classify_by_lexicon_table(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same with a lexicon of any size, as a table (kind, category, word).

    Every word of an item meets the lexicon in a join by equality; Spark broadcasts it or
    not, by its size. Hits are counted per item and category before they are shuffled, so
    what moves then is an id, a category and a number, and no text. ``item_id``
    is unique within a kind; repeated lines of the lexicon count once. Categories off the
    vocabulary come after those on it, in the order of their names.
    """
    order = F.lit(None).cast("int")
    for kind, names in vocab.VOCABULARY.items():
        place = F.array_position(F.array(*map(F.lit, names)), F.col("category")).cast("int")
        order = F.when(F.col("kind") == kind, F.when(place > 0, place)).otherwise(order)
    known = lexicon.select("kind", "category", "word", F.coalesce(order, F.lit(2**31 - 1)).alias("order")).distinct()
    tokens = items.select("item_id", "kind", F.explode(words(F.col("text"))).alias("word"))
    hits = tokens.join(known, ["kind", "word"]).groupBy("item_id", "kind", "category", "order").agg(F.count(F.lit(1)).alias("score"))
    best = hits.groupBy("item_id", "kind").agg(F.min(F.struct((-F.col("score")).alias("minus"), "order", "category")).alias("_best"))
    score = F.coalesce(-F.col("_best.minus"), F.lit(0))
    return items.join(best, ["item_id", "kind"], "left").select(
        *(items[c] for c in items.columns),
        F.coalesce("_best.category", F.lit(vocab.OTHER)).alias("category"),
        F.when(score >= 3, "High").when(score == 2, "Medium").otherwise("Low").alias("confidence"),
        F.concat(score.cast("string"), F.lit(" lexicon words")).alias("reasoning"),
    )


# -- user callable (CAT1, CAT2) ---------------------------------------------


_ANSWER = ("category", "confidence", "reasoning", "status")
_TOKENS = ("prompt_tokens", "completion_tokens")


def classify_with(
    items: DataFrame,
    classify: Classifier,
    batch_size: int = vocab.BATCH_SIZE,
    tasks: int | None = None,
) -> DataFrame:
    """Ask ``classify(texts, kind)`` for ``batch_size`` texts of one kind at a time.

    The items keep their own columns; nothing is joined. Batches are filled across Arrow
    batches, so a task has at most one short batch per kind. An answer that echoes
    another text is marked, an item without answer stays unanswered and is retried by
    the next run, and an answer too many becomes a row of its own without an item. An
    answer may name what it cost, as ``prompt_tokens`` and ``completion_tokens``. Retries
    and back-off belong into ``classify``; what it raises fails the task, and Spark retries
    that. Give ``tasks`` to spread a slow classifier over more tasks than the input has
    partitions.

    What is sent to the workers is closed in itself: they need pandas, not this package.
    """
    if tasks is not None:
        items = items.repartition(tasks)
    own = items.columns
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in items.schema.fields]
        + [T.StructField(n, T.StringType()) for n in _ANSWER]
        + [T.StructField(n, T.LongType()) for n in _TOKENS]
    )
    answer, tokens = _ANSWER, _TOKENS
    answered_, mismatched, unanswered, surplus = ANSWERED, MISMATCHED, UNANSWERED, SURPLUS

    def beside(texts: list[str], replies: list[Answer]) -> list[tuple]:
        """One row per text: what was replied at its place and what to make of it; then one
        per answer that has no text."""
        rows = []
        for k in range(max(len(texts), len(replies))):
            if k >= len(replies):
                rows.append((None, None, None, unanswered, None, None))
                continue
            reply = replies[k]
            if k >= len(texts):
                status = surplus
            else:
                status = answered_ if reply.get("text", texts[k]) == texts[k] else mismatched
            rows.append((*(reply.get(f) for f in answer[:3]), status, *(reply.get(f) for f in tokens)))
        return rows

    def answered(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
        out = []
        for start in range(0, len(rows), batch_size):
            batch = rows.iloc[start : start + batch_size].reset_index(drop=True)
            found = beside(batch["text"].tolist(), list(classify(batch["text"].tolist(), kind)))
            columns = pd.DataFrame(found, columns=[*answer, *tokens], dtype=object)
            for name in tokens:
                columns[name] = columns[name].astype("Int64")
            if len(found) > len(batch):
                batch = batch.astype(object).reindex(range(len(found)))
                batch = batch.where(batch.notna(), None)
                if "kind" in own:
                    batch["kind"] = kind
            out.append(pd.concat([batch, columns], axis=1))
        return pd.concat(out, ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, pd.DataFrame] = {}
        for frame in frames:
            for kind, rows in frame.groupby("kind", sort=False, dropna=False):
                if kind in waiting:
                    rows = pd.concat([waiting.pop(kind), rows], ignore_index=True)
                full = len(rows) - len(rows) % batch_size
                if full:
                    yield answered(rows.iloc[:full], kind)
                if full < len(rows):
                    waiting[kind] = rows.iloc[full:]
        for kind, rows in waiting.items():
            yield answered(rows, kind)

    return items.mapInPandas(run, schema)


# -- checks (JOIN4, CAT3) ---------------------------------------------------


def listed_category(kind: Column, category: Column) -> Column:
    """The category if the kind's vocabulary lists it, else "Other"."""
    pain, request = vocab.KINDS
    listed = F.when(kind == pain, _isin(category, vocab.VOCABULARY[pain])).otherwise(
        _isin(category, vocab.VOCABULARY[request])
    )
    return F.when(listed, category).otherwise(vocab.OTHER)


def check_category(df: DataFrame) -> DataFrame:
    """Off-list categories become "Other"; what was said is kept as ``category_raw``."""
    return df.withColumn("category_raw", F.col("category")).withColumn(
        "category", listed_category(F.col("kind"), F.col("category"))
    )


def confidence_is_valid(confidence: Column) -> Column:
    return F.coalesce(_isin(confidence, vocab.CONFIDENCE_LEVELS), F.lit(False))


def fate(status: Column, confidence: Column) -> Column:
    """What becomes of an answer. Unanswered items are simply still pending."""
    return (
        F.when(status == UNANSWERED, PENDING)
        .when((status == ANSWERED) & confidence_is_valid(confidence), ACCEPTED)
        .otherwise(QUARANTINED)
    )


def _with_fate(answers: DataFrame, wanted: str) -> DataFrame:
    return answers.where(fate(F.col("status"), F.col("confidence")) == wanted)


def accepted(answers: DataFrame) -> DataFrame:
    """Answers fit for analysis."""
    return _with_fate(answers, ACCEPTED)


def quarantined(answers: DataFrame) -> DataFrame:
    """Answers that are not."""
    return _with_fate(answers, QUARANTINED)


# -- threads to feedback (CAT5) ---------------------------------------------


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, without the spaces around them; empty ones dropped."""
    pieces = F.transform(F.split(text, "[.!?\n]+", -1), lambda s: F.btrim(s))
    return F.filter(pieces, lambda s: s != "")


def analyse_threads(threads: DataFrame, text: Column) -> DataFrame:
    """The built-in, plain stand-in for a thread analyser: cue words decide.

    Adds ``pain_points``, ``feature_requests``, ``sentiment``, ``priority`` and
    ``user_type``. Any function with the same output columns can take its place.
    """

    cues = (
        vocab.PAIN_CUES, vocab.REQUEST_CUES, vocab.POSITIVE_CUES, vocab.NEGATIVE_CUES,
        vocab.HIGH_PRIORITY_CUES, vocab.MEDIUM_PRIORITY_CUES, vocab.DEVELOPER_CUES,
    )
    known = {w for group in cues for w in group}

    def hits(group: Sequence[str]) -> Column:
        return count_words(F.col("_hits"), group)

    def naming(group: Sequence[str]) -> Column:
        """Sentences that name one of the words; most texts need no look at sentences."""
        options = F.array(*map(F.lit, group))
        found = F.filter(
            sentences(F.col("_text")), lambda sentence: F.arrays_overlap(words(sentence), options)
        )
        return F.when(hits(group) > 0, found).otherwise(F.array().cast("array<string>"))

    positive, negative = hits(vocab.POSITIVE_CUES), hits(vocab.NEGATIVE_CUES)
    return (
        threads.withColumn("_text", text)
        .withColumn("_hits", F.filter(words(F.col("_text")), lambda w: _isin(w, known)))
        .select(
            *threads.columns,
            naming(vocab.PAIN_CUES).alias("pain_points"),
            naming(vocab.REQUEST_CUES).alias("feature_requests"),
            F.when(negative > positive, "negative")
            .when(positive > negative, "positive")
            .otherwise("neutral")
            .alias("sentiment"),
            F.when(hits(vocab.HIGH_PRIORITY_CUES) > 0, "high")
            .when(hits(vocab.MEDIUM_PRIORITY_CUES) > 0, "medium")
            .otherwise("low")
            .alias("priority"),
            F.when(hits(vocab.DEVELOPER_CUES) > 0, "developer").otherwise("general").alias("user_type"),
        )
    )


def thread_text(comments: Column) -> Column:
    """All cleaned bodies of a thread, one after the other."""
    return F.array_join(F.transform(comments, lambda c: c["cleaned_body"]), "\n")

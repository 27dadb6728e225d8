"""Feedback items: exploding threads, dense numbering, batches, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions.scalars import floor_divide
from voxmill.operators.numbering import sums_before

METADATA = ("thread_id", "source", "sentiment", "priority", "user_type")
# A list position is an INT, so one thread's items fit into this span.
_LIST_SPAN = 2**31


# -- nested comments (ARR2, FLT5, PRJ6) -------------------------------------


def first_post_then_replies(first: Column, replies: Column) -> Column:
    """The comments array: the opening post, then the replies in their order."""
    return F.concat(F.array(first), replies)


def with_body(comments: Column) -> Column:
    """Comments that have a body at all."""
    return F.filter(comments, lambda c: c["body"].isNotNull())


def comment_pages(comments: DataFrame, page_size: int = 50) -> DataFrame:
    """Nest a flat comment table (thread_id, pos, body) into pages of bounded size.

    ``pos`` is unique within a thread, so a page never holds more than ``page_size``
    comments and even the longest thread is spread over many tasks.
    """
    page = floor_divide(F.col("pos"), page_size).alias("page")
    return (
        comments.groupBy("thread_id", page)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("comments"))
    )


# -- items (ARR1, PRJ7) -----------------------------------------------------


def _part(name: str) -> Column:
    """A part of an id: a colon or backslash in it is marked, and so is a missing one, so
    different places never get one id."""
    marked = F.regexp_replace(F.col(name).cast("string"), r"([:\\])", r"\\$1")
    return F.coalesce(marked, F.lit("\\N"))


def explode_items(threads: DataFrame, thread_pos: str | None = None) -> DataFrame:
    """One row per pain point and feature request, with the thread's metadata.

    One pass and no shuffle. ``item_id`` is built from the content's place, so a second
    run gives the same ids. With ``thread_pos`` (the thread's BIGINT position) the row
    also gets ``item_pos``, its place in thread order, then list order.
    """

    def entries(kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(kind), F.array().cast("array<string>")),
            lambda text, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("list_pos"), text.alias("text")
            ),
        )

    kept = [c for c in threads.columns if c not in vocab.KINDS]
    items = threads.select(*kept, F.inline(F.concat(*map(entries, vocab.KINDS))))
    items = items.withColumn("item_id", F.concat_ws(":", _part("source"), _part("thread_id"), "kind", "list_pos"))
    if thread_pos is not None:
        place = F.col(thread_pos).cast("decimal(19,0)") * F.lit(_LIST_SPAN) + F.col("list_pos")
        items = items.withColumn("item_pos", place.cast("decimal(30,0)"))
    return items


# -- dense numbering (ARR3) -------------------------------------------------


def batched_items(
    threads: DataFrame, thread_pos: str, batch_size: int = vocab.BATCH_SIZE
) -> DataFrame:
    """Items with their dense place per kind and the batch that makes.

    The numbering runs over threads, weighted by their list sizes, so items are numbered
    before they exist and are never shuffled for it.
    """
    sizes = {f"_before_{k}": F.coalesce(F.size(k), F.lit(0)) for k in vocab.KINDS}
    sizes = {n: F.greatest(s, F.lit(0)).cast("bigint") for n, s in sizes.items()}
    numbered = sums_before(threads, thread_pos, sizes)

    def by_kind(suffix: str = "") -> Column:
        pain, request = (F.col(f"_before_{k}{suffix}") for k in vocab.KINDS)
        return F.when(F.col("kind") == vocab.PAIN_POINTS, pain).otherwise(request)

    rounded_up = by_kind("_total") + (batch_size - 1)
    return (
        explode_items(numbered, thread_pos)
        .withColumn("item_index", by_kind() + F.col("list_pos"))
        .withColumn("batch_num", floor_divide(F.col("item_index"), batch_size) + 1)
        .withColumn("pos_in_batch", F.pmod("item_index", F.lit(batch_size)).cast("int"))
        .withColumn("total_batches", floor_divide(rounded_up, batch_size))
        .drop(*sizes, *(f"{n}_total" for n in sizes))
    )


# -- prompts (ARR4, PRJ8, TXT18) --------------------------------------------


def numbered_list(texts: Column) -> Column:
    """``1. text`` and so on, one per line."""
    return F.array_join(
        F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n"
    )


def vocabulary_list(kind: Column) -> Column:
    """The category names of a kind as a dash list."""
    lists = {k: "\n".join(f"- {c}" for c in v) for k, v in vocab.VOCABULARY.items()}
    return F.when(kind == vocab.PAIN_POINTS, F.lit(lists[vocab.PAIN_POINTS])).otherwise(
        F.lit(lists[vocab.FEATURE_REQUESTS])
    )


def prompt_text(kind: Column, texts: Column, product: str) -> Column:
    before, after = vocab.PROMPT_HEAD.replace("{product}", product).split("{categories}")

    def named(k: str) -> Column:
        return F.lit(before.format(kind_words=k.replace("_", " "), kind=k))

    pain, request = vocab.KINDS
    return F.concat(
        F.when(kind == pain, named(pain)).otherwise(named(request)),
        vocabulary_list(kind),
        F.lit(after),
        numbered_list(texts),
        F.lit(vocab.PROMPT_TAIL),
    )


def prompts(batched: DataFrame, product: str) -> DataFrame:
    """One prompt per batch. A batch holds at most ``batch_size`` items."""
    grouped = batched.groupBy("kind", "batch_num").agg(
        F.array_sort(F.collect_list(F.struct("pos_in_batch", "text"))).alias("entries"),
        F.count(F.lit(1)).alias("n_items"),
    )
    return grouped.select(
        "kind",
        "batch_num",
        "n_items",
        prompt_text(F.col("kind"), F.col("entries.text"), product).alias("prompt"),
    )

"""Cleaning whole thread tables (PRJ6)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions.text import clean_text


def clean_threads(
    threads: DataFrame,
    product: str | None = None,
    prefixes: Iterable[str] = vocab.BOILERPLATE_PREFIXES,
) -> DataFrame:
    """Add ``cleaned_body`` to every comment, inside the array: no explode, no shuffle."""
    prefixes = list(prefixes)
    cleaned = F.transform(
        "comments",
        lambda c: c.withField(
            "cleaned_body", clean_text(c["body"], F.col("source"), product, prefixes)
        ),
    )
    return threads.withColumn("comments", cleaned)


def clean_comments(
    comments: DataFrame,
    body: str = "body",
    source: str | None = "source",
    product: str | None = None,
    prefixes: Iterable[str] = vocab.BOILERPLATE_PREFIXES,
) -> DataFrame:
    """The same for a flat comment table."""
    of = F.col(source) if source is not None else None
    return comments.withColumn("cleaned_body", clean_text(F.col(body), of, product, prefixes))

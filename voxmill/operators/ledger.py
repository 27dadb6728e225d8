"""What was handled before: anti-joins instead of state files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger_of(threads: DataFrame) -> DataFrame:
    """The ledger is read off the stored threads, so it cannot run ahead of the data."""
    return threads.select("source", F.col("thread_id").alias("item_id"))


def not_in_ledger(df: DataFrame, ledger: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the ledger (JOIN1, FLT6). Keys are unique, so no skew.

    Come here after a top-k, not before: a second run gives fewer rows, not the next k.
    """
    return df.join(ledger.select(*on), list(on), "left_anti")


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items with no stored result yet (SNK5): resume by id, never by count."""
    return not_in_ledger(items, done, ["item_id"])

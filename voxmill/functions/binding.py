"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    A chain of steps that each name their input twice would otherwise double the
    expression with every step.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def where_present(text: Column, literal: str, step: Callable[[Column], Column]) -> Column:
    """Apply ``step`` only to texts that hold ``literal``.

    A plain byte search is far cheaper than a regex pass, and most texts hold none of a
    given construct. ``literal`` must be part of everything ``step`` can match.
    """
    return let(text, lambda t: F.when(F.contains(t, F.lit(literal)), step(t)).otherwise(t))

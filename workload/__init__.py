"""Queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from workload.registry import QUERIES, SQL, Query


def _load() -> None:
    from workload import categories, items, jobs, payloads, reports, selection, texts  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

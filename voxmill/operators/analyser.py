"""Threads to feedback by an analyser of the user's own (CAT5).

    pages      each thread's cleaned comments, in order, as pages of bounded size
    analysed   the pages, dealt evenly over the tasks whatever thread they are of
    threads    the pages' findings put together, one row per thread
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.session import stored_once

Page = Mapping[str, object]
Analyser = Callable[[list[Page]], Iterable[Mapping[str, object] | None]]

#: Pages that a callable gets at once, comments of a page, and characters of a comment.
PAGES, COMMENTS, CHARACTERS = 8, 16, 2000
#: Pages whose findings leave a worker together.
_FRAME = 1024
PRIORITIES = ("high", "medium", "low")
_LISTS = ("pain_points", "feature_requests")
_VOICES = ("sentiment", "user_type", "priority")
_TOKENS = ("prompt_tokens", "completion_tokens")


def _pieces(text: Column, width: int) -> Column:
    """A text in pieces of ``width`` characters; none of a blank one."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int"))
    cut = F.transform(starts, lambda k: F.substr(text, k * width + 1, F.lit(width)))
    return F.when(F.rlike(text, F.lit(r"\S")), cut).otherwise(F.array().cast("array<string>"))


def pages(
    threads: DataFrame, keys: Sequence[str], comments: int = COMMENTS, characters: int = CHARACTERS, body: str = "cleaned_body"
) -> DataFrame:
    """(keys, title, page, n_pages, text) of every page: at most ``comments`` comments of
    at most ``characters`` each, one per line; a longer one counts as several. Whole threads
    are paged, nothing is left out but blank bodies. A thread without any has no page.
    """
    cut = F.flatten(F.transform(F.coalesce("comments", F.array()), lambda c: _pieces(c[body], characters)))
    title = F.col("title") if "title" in threads.columns else F.lit(None)
    rows = threads.select(*keys, title.cast("string").alias("title"), cut.alias("_pieces"))
    numbers = F.when(
        F.size("_pieces") > 0, F.sequence(F.lit(0), F.floor((F.size("_pieces") - 1) / comments).cast("int"))
    )
    # Pages are cut before they are dealt out: what moves is one page, never a whole thread.
    cut_pages = F.transform(
        numbers,
        lambda k: F.struct(
            k.alias("page"),
            F.size(numbers).alias("n_pages"),
            F.array_join(F.slice("_pieces", k * comments + 1, comments), "\n").alias("text"),
        ),
    )
    return rows.select(*keys, "title", F.inline(cut_pages))


def _asker(analyse: Analyser, keys: Sequence[str], batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Asks for ``batch`` pages at once and hands on the findings of many batches together:
    a frame costs the same whether it has eight rows or a thousand."""
    lists, voices, tokens, keys, together = _LISTS, _VOICES, _TOKENS, list(keys), max(_FRAME // batch, 1) * batch

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for first in range(0, len(rows), together):
                some = rows.iloc[first : first + together]
                pages, found = some[["title", "page", "n_pages", "text"]].to_dict("records"), []
                for start in range(0, len(pages), batch):
                    asked = pages[start : start + batch]
                    answers = list(analyse(asked))
                    if len(answers) > len(asked):
                        raise ValueError(f"{len(answers)} analyses of {len(asked)} pages")
                    found += answers + [None] * (len(asked) - len(answers))
                out = some[[*keys, "page"]].reset_index(drop=True)
                out["answered"] = [f is not None for f in found]
                for name in (*lists, *voices):
                    out[name] = pd.Series([(f or {}).get(name) for f in found], dtype=object)
                for name in tokens:
                    out[name] = pd.array([(f or {}).get(name) for f in found], dtype="Int64")
                yield out

    return run


def _asked(frame: DataFrame, analyse: Analyser, keys: Sequence[str], batch: int) -> DataFrame:
    """Every page with what ``analyse`` found on it; all is NULL where it gave nothing."""
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    own = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{own}, page int, answered boolean, " + ", ".join(
        [f"{n} array<string>" for n in _LISTS] + [f"{n} string" for n in _VOICES] + [f"{n} bigint" for n in _TOKENS]
    )
    return frame.mapInPandas(_asker(analyse, keys, batch), schema)


def analyse_with(
    threads: DataFrame,
    analyse: Analyser,
    keys: Sequence[str] = ("source", "thread_id"),
    batch: int = PAGES,
    comments: int = COMMENTS,
    characters: int = CHARACTERS,
    tasks: int | None = None,
) -> DataFrame:
    """``threads`` with ``pain_points``, ``feature_requests``, ``sentiment``, ``priority``,
    ``user_type``, ``n_pages``, ``n_analysed`` and tokens, found by ``analyse(pages)``.

    ``analyse`` gets up to ``batch`` pages (title, page from 0, n_pages, text) and gives a
    mapping for each in order; None, or an answer too few, leaves a page unanalysed, which
    ``n_analysed`` tells. Pages are of bounded size and dealt over ``tasks`` by number, so a
    thread with a third of all comments is read by many tasks, and no task holds a thread.

    A thread's points are those of its pages in their order, repeated ones once. Its priority is
    the highest named; sentiment and user type are what most pages say, of equals the first
    by name. ``keys`` tell threads apart and may be NULL; rows with equal keys count as one
    thread and get the findings of all. A thread without text has no page and empty lists. Columns that
    clash with the new ones are replaced. No rows give no rows.
    """
    keys = list(keys)
    spread = pages(threads, keys, comments, characters)
    spread = spread.repartition(*([tasks] if tasks else []), *keys, "page")
    # Stored, so that nothing is asked twice.
    found = stored_once(_asked(spread, analyse, keys, batch), "analysed-pages")

    def joined(name: str) -> Column:
        some = F.collect_list(F.struct("page", F.coalesce(name, F.array()).alias(name)))
        return F.array_distinct(F.flatten(F.transform(F.array_sort(some), lambda p: p[name]))).alias(name)

    rank = F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0).cast("long"))
    together = found.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(
        *map(joined, _LISTS),
        F.mode("sentiment", True).alias("sentiment"),
        F.mode("user_type", True).alias("user_type"),
        F.get(F.array(*map(F.lit, PRIORITIES)), (F.min(rank) - 1).cast("int")).alias("priority"),
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("answered").alias("n_analysed"),
        *(F.sum(name).alias(name) for name in _TOKENS),
    )
    new = together.columns[len(keys) :]
    own = threads.drop(*new)
    same = F.lit(True)
    for k in keys:
        same = same & own[k].eqNullSafe(F.col(f"_{k}"))
    empty = {n: F.array().cast("array<string>") for n in _LISTS} | {n: F.lit(0) for n in ("n_pages", "n_analysed")}
    return own.join(together, same, "left").select(
        *(own[c] for c in own.columns), *(F.coalesce(n, empty[n]).alias(n) if n in empty else F.col(n) for n in new)
    )

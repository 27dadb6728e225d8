"""From landed payloads to the threads worth reading.

Each job sifts the landed texts once: what can't be ranked goes to quarantine before any
ranking, of the rest only the fields that are ranked on are parsed. A thread that landed
several times counts once, with its last version. Only the winners' texts are parsed whole.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import schemas, vocab
from voxmill.functions import scalars
from voxmill.operators import select
from voxmill.operators.ledger import ledger_of, not_in_ledger
from voxmill.session import stored_once
from voxmill.sinks import tables
from voxmill.sinks.commits import append_once, commit_rows, commits, is_committed
from voxmill.sources import payloads as raw

#: What a run leaves behind in numbers.
RUN = "source string, landed bigint, quarantined bigint, collected bigint, stored bigint, done_at timestamp"


class Collected(NamedTuple):
    """What a job found.

    ``threads``: normalised. ``quarantine``: (source, thread_id, problem, raw), both of texts
    that could not be ranked and of winners that could not be normalised. ``counts``: texts
    ``landed`` and, of these, ``quarantined`` before the ranking.
    """

    source: str
    threads: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def _uncollected(winners: DataFrame, ledger: DataFrame | None, source: str) -> DataFrame:
    """Winners the ledger lacks. Comes after the top-k: a re-run does not reach further."""
    if ledger is None:
        return winners
    done = ledger.where(F.col("source") == source).select(F.col("item_id").alias("_id"))
    keyed = winners.withColumn("_id", F.col("id").cast("string"))
    return not_in_ledger(keyed, done, ["_id"]).drop("_id")


def _collected(
    source: str,
    landed: DataFrame,
    text: str,
    sifted: raw.Sifted,
    winners: DataFrame,
    schema: str,
    normalise: Callable[[DataFrame], DataFrame],
) -> Collected:
    """Parse and normalise the winners, at most a few hundred rows, and part them."""
    done = stored_once(normalise(raw.reread(landed, text, winners, schema)), "winners")
    bad = raw.quarantine(done).select("thread_id", "problem", "raw").unionByName(sifted.quarantine)
    return Collected(source, raw.sound(done), bad.select(F.lit(source).alias("source"), "*"), sifted.counts)


def collect_issues(
    landed: DataFrame,
    as_of: dt.datetime | Column,
    ledger: DataFrame | None = None,
    k: int = vocab.TOP_ISSUES,
    *,
    text: str = "value",
    version: str | Column | None = None,
) -> Collected:
    """Open issues updated lately: the top by ``+1`` reactions and by comments, merged, the
    most engaged ``k`` of them.

    ``landed`` has one JSON object per row in ``text``; ``version`` tells the order in which
    they landed, and where it is equal or not given the last update counts. Payloads that
    do not tell ``+1`` apart are ranked by all reactions.
    """
    updated = scalars.parse_iso(F.col("updated_at"))
    sifted = raw.sift(
        landed, text, schemas.ISSUE_RANKING, version, no_id=F.col("id").isNull(), no_time=updated.isNull()
    )
    last = raw.latest(sifted.sound, updated).withColumn("updated", updated)
    eligible = select.recent(select.without_pull_requests(select.open_only(last)), "updated", as_of)
    total = scalars.nested_or(F.col("reactions.total_count"), 0)
    candidates = stored_once(
        eligible.select(
            "id",
            F.coalesce(F.col("reactions.`+1`"), total).alias("plus_one"),
            total.alias("reactions"),
            scalars.nested_or(F.col("comments"), 0).alias("n_comments"),
            *raw.DIGEST,
        ),
        "candidates",
    )
    merged = select.merge_candidates(
        [select.ranked(candidates, by, k, "id") for by in ("plus_one", "n_comments")], "id"
    )
    score = scalars.issue_engagement(F.col("reactions"), F.col("n_comments"))
    winners = _uncollected(select.top(merged, score, k, "first_place"), ledger, vocab.GITHUB)
    return _collected(vocab.GITHUB, landed, text, sifted, winners, schemas.ISSUE_PAYLOAD, raw.normalise_issues)


def collect_posts(
    landed: DataFrame,
    as_of: dt.datetime | Column,
    ledger: DataFrame | None = None,
    k: int = vocab.TOP_POSTS,
    candidates: int = 2 * vocab.TOP_POSTS,
    *,
    text: str = "value",
    version: str | Column | None = None,
) -> Collected:
    """The posts leading by score and by comments, of these the recent ones, of these the
    most engaged ``k``. ``text`` and ``version`` are as for issues; without a version the
    last creation counts."""
    sifted = raw.sift(
        landed, text, schemas.POST_RANKING, version,
        no_id=F.col("id").isNull(), no_time=F.col("created_utc").isNull(),
    )
    narrow = stored_once(raw.latest(sifted.sound, "created_utc").drop("_version"), "candidates")
    lists = [
        select.recent(
            select.ranked(narrow, by, candidates, "id"),
            scalars.from_epoch(F.col("created_utc")),
            as_of,
        )
        for by in ("score", "num_comments")
    ]
    score = scalars.post_engagement(F.col("score"), F.col("num_comments"))
    merged = select.merge_candidates(lists, "id")
    winners = _uncollected(select.top(merged, score, k, "first_place"), ledger, vocab.REDDIT)
    return _collected(vocab.REDDIT, landed, text, sifted, winners, schemas.POST_PAYLOAD, raw.normalise_posts)


def collect_topics(
    landed: DataFrame,
    as_of: dt.datetime | Column,
    base_url: str,
    ledger: DataFrame | None = None,
    categories: Sequence[int] = vocab.TOPIC_CATEGORY_IDS,
    k: int = vocab.TOP_TOPICS,
    *,
    text: str = "value",
    version: str | Column | None = None,
) -> Collected:
    """The most engaged ``k`` recent topics of each category. ``text`` and ``version`` are as
    for issues; without a version the last creation counts."""
    created = scalars.parse_iso(F.col("created_at"))
    sifted = raw.sift(
        landed, text, schemas.TOPIC_RANKING, version, no_id=F.col("id").isNull(), no_time=created.isNull()
    )
    last = raw.latest(sifted.sound, created)
    score = scalars.topic_engagement(F.col("reply_count"), F.col("views"))
    narrow = last.select("id", "category_id", created.alias("created"), score.alias("engagement"), *raw.DIGEST)
    recent = select.recent(select.in_categories(narrow, ids=categories), "created", as_of)
    winners = select.top_per_group(recent, "category_id", "engagement", k, "id")
    winners = _uncollected(winners, ledger, vocab.DISCOURSE)
    return _collected(
        vocab.DISCOURSE, landed, text, sifted, winners, schemas.TOPIC_PAYLOAD,
        lambda payloads: raw.normalise_topics(payloads, base_url),
    )


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """What the thread table at ``path`` holds, for the next run; None before the first."""
    threads = tables.stored(spark, path)
    return None if threads is None else ledger_of(threads)


def store(found: Collected, path: str, run: str | None = None) -> int:
    """Append threads to the table at ``path`` and say how many were new.

    Threads of all sources share one table; a field that a source lacks is NULL. What is
    stored already stays as it is. The quarantine grows beside it, in ``<path>_quarantine``,
    each text once per problem, and a row of numbers per run in ``<path>_runs``. All three
    are commits named after ``run`` and the source, so a run that died can be run again.
    """
    spark = found.threads.sparkSession
    commit = f"{run or uuid.uuid4().hex}-{found.source}"
    whole = found.threads.select(
        *(
            (F.col(f.name) if f.name in found.threads.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in spark.createDataFrame([], schemas.THREAD).schema
        )
    )
    append_once(whole, path, commit, ["source", "thread_id"], partition_by=("source",))
    digest = F.sha2(F.coalesce("raw", F.lit("")), 256)
    bad = found.quarantine.withColumn("digest", digest)
    append_once(bad, f"{path}_quarantine", commit, ["source", "problem", "digest"])
    added = commits(spark, path).where(F.col("commit") == commit).first()["n_rows"]
    if not is_committed(spark, f"{path}_runs", commit):
        now = dt.datetime.now(dt.timezone.utc)
        facts = (found.source, found.counts["landed"], found.counts["quarantined"], found.threads.count(), added, now)
        commit_rows(spark.createDataFrame([facts], RUN), f"{path}_runs", commit)
    return added

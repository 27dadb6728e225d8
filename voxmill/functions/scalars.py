"""Engagement, default, URL, date, JSON and cost expressions."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill import vocab


def floor_divide(number: Column, by: int) -> Column:
    """Whole-number division that rounds down."""
    return F.call_function("div", number - F.pmod(number, F.lit(by)), F.lit(by))


# -- engagement (PRJ1-3) ----------------------------------------------------


def issue_engagement(reactions: Column, comments: Column) -> Column:
    return reactions + comments


def post_engagement(score: Column, num_comments: Column) -> Column:
    return score + num_comments


def topic_engagement(reply_count: Column, views: Column) -> Column:
    """Ten views count as one reply; missing numbers count as none."""
    return F.coalesce(reply_count, F.lit(0)) + floor_divide(F.coalesce(views, F.lit(0)), 10)


# -- defaults and URLs (PRJ4, PRJ5) -----------------------------------------


def post_author(author: Column) -> Column:
    """No author, or an empty one, is a deleted account."""
    return F.coalesce(F.nullif(author, F.lit("")), F.lit(vocab.DELETED_AUTHOR))


def topic_author(author: Column) -> Column:
    return F.coalesce(author, F.lit(vocab.UNKNOWN_AUTHOR))


def post_url(permalink: Column) -> Column:
    return F.concat(F.lit(vocab.POST_URL_BASE), permalink)


def topic_url(base_url: str, slug: Column, topic_id: Column) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/t/"), slug, F.lit("/"), topic_id)


# -- dates (DAT1-4) ---------------------------------------------------------


def parse_iso(text: Column) -> Column:
    """ISO text with ``Z`` or an offset to a timestamp; NULL where it is none."""
    return F.try_to_timestamp(text)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def cutoff(as_of: dt.datetime | Column, days: int = vocab.RECENT_DAYS) -> Column:
    """The moment ``days`` times 24 hours before ``as_of``; there is no hidden clock.

    Counted in hours, since a session's time zone may give a calendar day 23 or 25.
    """
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return moment - F.make_interval(hours=F.lit(24 * days))


def iso_text(moment: Column) -> Column:
    """Timestamps as ISO text in UTC, with microseconds where there are any."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    seconds = F.timestamp_add("SECOND", F.unix_seconds(moment), epoch).cast("string")
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000)).cast("string")
    fraction = F.when(micros == "0", "").otherwise(F.concat(F.lit("."), F.lpad(micros, 6, "0")))
    return F.concat(F.replace(seconds, F.lit(" "), F.lit("T")), fraction, F.lit("+00:00"))


# -- JSON (JSN2, JSN3) ------------------------------------------------------


def to_document(*columns: str) -> Column:
    """One JSON text of the named columns; Unicode stays readable."""
    return F.to_json(F.struct(*columns))


def nested_or(value: Column, default: object) -> Column:
    """A nested field, or the default wherever a level of it is missing."""
    return F.coalesce(value, F.lit(default))


# -- tokens and cost (MTH1-3, AGG8) -----------------------------------------


def estimate_tokens(text: Column) -> Column:
    """Four characters make one token, rounded down."""
    return floor_divide(F.length(text).cast("bigint"), vocab.CHARS_PER_TOKEN)


def token_cost(
    tokens_in: Column,
    tokens_out: Column,
    rate_in: Decimal = vocab.INPUT_COST_PER_TOKEN,
    rate_out: Decimal = vocab.OUTPUT_COST_PER_TOKEN,
) -> Column:
    """Exact cost. Decimals add up to the same total in every order."""
    return (
        tokens_in.cast("decimal(18,0)") * F.lit(rate_in) + tokens_out.cast("decimal(18,0)") * F.lit(rate_out)
    ).cast("decimal(28,9)")


def estimate_batch_cost(
    prompt: Column,
    n_items: Column,
    rate_in: Decimal = vocab.INPUT_COST_PER_TOKEN,
    rate_out: Decimal = vocab.OUTPUT_COST_PER_TOKEN,
    tokens_per_item: int = vocab.OUTPUT_TOKENS_PER_ITEM,
) -> Column:
    return token_cost(estimate_tokens(prompt), n_items * tokens_per_item, rate_in, rate_out)

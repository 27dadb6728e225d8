"""Explicit schemas, as DDL. Ids are strings, times are timestamps; nothing is inferred."""

from __future__ import annotations

COMMENT = "comment_id: STRING, author: STRING, created_at: TIMESTAMP, body: STRING"
COMMENTS = f"ARRAY<STRUCT<{COMMENT}>>"

THREAD = (
    "source STRING, thread_id STRING, url STRING, title STRING, author STRING,"
    f" created_at TIMESTAMP, comments {COMMENTS},"
    " issue_number BIGINT, state STRING, labels ARRAY<STRING>,"
    " score BIGINT, num_comments BIGINT, reply_count BIGINT, views BIGINT"
)

ANALYSED_THREAD = (
    "thread_id STRING, source STRING, sentiment STRING, priority STRING, user_type STRING,"
    " pain_points ARRAY<STRING>, feature_requests ARRAY<STRING>"
)

ITEM = (
    "item_id STRING, kind STRING, text STRING, thread_id STRING, source STRING,"
    " sentiment STRING, priority STRING, user_type STRING"
)

CATEGORISED_ITEM = ITEM + ", category STRING, confidence STRING, reasoning STRING"

LEDGER = "source STRING, item_id STRING"

MODEL_REPLY = "array<struct<text: string, category: string, confidence: string, reasoning: string>>"

# Raw payloads as landed by a crawler, one JSON object per line. Only the fields that are
# read are named; the reader skips the rest.
ISSUE_PAYLOAD = (
    "id BIGINT, number BIGINT, html_url STRING, title STRING, user STRUCT<login: STRING>,"
    " state STRING, pull_request STRING, reactions STRUCT<total_count: BIGINT, `+1`: BIGINT>, comments BIGINT,"
    " labels ARRAY<STRUCT<name: STRING>>, body STRING, created_at STRING, updated_at STRING,"
    " comment_list ARRAY<STRUCT<id: BIGINT, user: STRUCT<login: STRING>, created_at: STRING, body: STRING>>"
)
# What is ranked on: all that is parsed of a payload that does not win.
ISSUE_RANKING = (
    "id BIGINT, state STRING, pull_request STRING, updated_at STRING,"
    " reactions STRUCT<total_count: BIGINT, `+1`: BIGINT>, comments BIGINT"
)
POST_RANKING = "id STRING, score BIGINT, num_comments BIGINT, created_utc DOUBLE"
TOPIC_RANKING = "id BIGINT, category_id BIGINT, created_at STRING, reply_count BIGINT, views BIGINT"

POST_PAYLOAD = (
    "id STRING, permalink STRING, title STRING, author STRING, score BIGINT, num_comments BIGINT,"
    " created_utc DOUBLE, selftext STRING,"
    " comment_list ARRAY<STRUCT<id: STRING, author: STRING, created_utc: DOUBLE, body: STRING>>"
)
TOPIC_PAYLOAD = (
    "id BIGINT, slug STRING, title STRING, last_poster_username STRING, reply_count BIGINT,"
    " views BIGINT, created_at STRING, category_id BIGINT,"
    " post_stream STRUCT<posts: ARRAY<STRUCT<id: BIGINT, username: STRING, created_at: STRING, cooked: STRING>>>"
)

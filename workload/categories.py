"""Classifiers, landed model replies and the checks on both."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.operators import analyser, classify, replies
from voxmill.session import stored_once
from workload import views
from workload.registry import query

ANALYSED = f"WITH {views.ANALYSED_SQL}"

# What the landed replies of ``views.replies`` answer, by batch number modulo five.
ANSWERS_SQL = f"""{ANALYSED}, sized AS (
  SELECT *, count(*) OVER (PARTITION BY kind, batch_num) AS n_items FROM numbered),
answers AS (
  SELECT kind, batch_num, pos_in_batch, item_id,
    CASE WHEN batch_num % 5 = 0 OR (batch_num % 5 = 2 AND pos_in_batch = n_items - 1) THEN 'unanswered'
         WHEN batch_num % 5 = 4 AND pos_in_batch = 0 THEN 'mismatched' ELSE 'answered' END AS status,
    {views.REPLY_CATEGORY_SQL} AS said, {views.REPLY_CONFIDENCE_SQL} AS sure
  FROM sized
  UNION ALL
  SELECT kind, batch_num, n_items, NULL, 'surplus', 'Other', 'Low'
  FROM (SELECT DISTINCT kind, batch_num, n_items FROM sized WHERE batch_num % 5 = 3)),
attached AS (
  SELECT kind, batch_num, pos_in_batch, item_id, status,
         CASE WHEN status <> 'unanswered' THEN said END AS category,
         CASE WHEN status <> 'unanswered' THEN sure END AS confidence FROM answers)"""


def attached(spark, sf):
    batches = stored_once(views.batched(spark, sf), "batches")
    return replies.attach_replies(batches, views.replies(batches))


@query("join2_attach_replies", f"{ANSWERS_SQL} SELECT * FROM attached")
def join2(spark, sf):
    return attached(spark, sf).select(
        "kind",
        "batch_num",
        F.col("pos_in_batch").cast("bigint").alias("pos_in_batch"),
        "item_id",
        "status",
        "category",
        "confidence",
    )


@query(
    "cat2_metadata",
    f"""{ANSWERS_SQL} SELECT kind, category, n.source, n.sentiment, n.priority, n.user_type, count(*) AS n
    FROM attached a JOIN numbered n USING (item_id, kind) WHERE status = 'answered' GROUP BY ALL""",
)
def cat2(spark, sf):
    answered = attached(spark, sf).where(F.col("status") == classify.ANSWERED)
    dims = ("kind", "category", "source", "sentiment", "priority", "user_type")
    return answered.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cat3_confidence_check",
    f"""{ANSWERS_SQL} SELECT status,
      CASE WHEN status IN ('mismatched', 'surplus') OR confidence NOT IN ('High', 'Medium', 'Low') THEN 'quarantine'
           WHEN status = 'unanswered' THEN 'pending' ELSE 'accepted' END AS fate, count(*) AS n
    FROM attached GROUP BY ALL""",
)
def cat3(spark, sf):
    fate = classify.fate(F.col("status"), F.col("confidence"))
    return attached(spark, sf).groupBy("status", fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "jsn1_parse_replies",
    f"""{ANSWERS_SQL}
    SELECT kind, batch_num, pos_in_batch AS pos,
      CASE WHEN batch_num % 5 = 4 AND pos_in_batch = 0 THEN text || '?' ELSE text END AS text,
      {views.REPLY_CATEGORY_SQL} AS category, {views.REPLY_CONFIDENCE_SQL} AS confidence, 'by length' AS reasoning
    FROM sized WHERE batch_num % 5 <> 0 AND NOT (batch_num % 5 = 2 AND pos_in_batch = n_items - 1)
    UNION ALL SELECT DISTINCT kind, batch_num, n_items, 'extra', 'Other', 'Low', 'none asked'
    FROM sized WHERE batch_num % 5 = 3
    UNION ALL SELECT DISTINCT kind, batch_num, NULL, NULL, NULL, NULL, NULL FROM sized WHERE batch_num % 5 = 0""",
)
def jsn1(spark, sf):
    """Every answer of every reply, and a row without answer for a reply that is none."""
    parsed = replies.parsed_replies(views.replies(views.batched(spark, sf)))
    opened = parsed.select("kind", "batch_num", "answers", F.posexplode_outer("answers").alias("pos", "answer"))
    told = opened.where("answers IS NULL OR pos IS NOT NULL")
    return told.select("kind", "batch_num", F.col("pos").cast("bigint").alias("pos"), "answer.*")


def by_length(vocabulary, levels):
    """A user's classifier, as plain as can be; it takes what it needs along."""

    def classify_texts(texts: list[str], kind: str) -> list[dict[str, str]]:
        categories = vocabulary[kind]
        return [
            {
                "text": t,
                "category": categories[len(t) % len(categories)],
                "confidence": levels[len(t) % len(levels)],
                "reasoning": f"{len(t)} characters",
            }
            for t in texts
        ]

    return classify_texts


@query(
    "cat1_user_classifier",
    f"""{ANALYSED} SELECT item_id, kind,
      CASE kind WHEN 'pain_points' THEN {views.sql_list(vocab.PAIN_POINT_CATEGORIES)}[length(text) % 15 + 1]
           ELSE {views.sql_list(vocab.FEATURE_REQUEST_CATEGORIES)}[length(text) % 15 + 1] END AS category,
      ['High', 'Medium', 'Low'][length(text) % 3 + 1] AS confidence,
      length(text) || ' characters' AS reasoning, 'answered' AS status FROM batched""",
)
def cat1(spark, sf):
    items = views.exploded(spark, sf).select("item_id", "kind", "text")
    return classify.classify_with(
        items, by_length(vocab.VOCABULARY, vocab.CONFIDENCE_LEVELS)
    ).drop("text", "prompt_tokens", "completion_tokens")


def _lexicon_rows() -> str:
    rows = []
    for kind, categories in views.LEXICON.items():
        order = {c: i for i, c in enumerate(vocab.VOCABULARY[kind])}
        for category, words in categories.items():
            rows += [
                f"({views.quoted(kind)}, {views.quoted(category)}, {order[category]}, {views.quoted(w)})"
                for w in words
            ]
    return ", ".join(rows)


LEXICON_ANSWERS_SQL = f"""{ANALYSED}, lexicon(kind, category, ord, word) AS (VALUES {_lexicon_rows()}),
tokens AS (SELECT item_id, kind, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM batched),
scores AS (SELECT item_id, category, ord, count(*) AS score FROM tokens JOIN lexicon USING (kind, word) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS nth FROM scores),
lexicon_answers AS (
  SELECT item_id, kind, coalesce(category, 'Other') AS category,
    CASE WHEN score >= 3 THEN 'High' WHEN score = 2 THEN 'Medium' ELSE 'Low' END AS confidence,
    coalesce(score, 0) || ' lexicon words' AS reasoning
  FROM batched LEFT JOIN (SELECT item_id, category, score FROM best WHERE nth = 1) USING (item_id))"""


@query("cat4_lexicon", f"{LEXICON_ANSWERS_SQL} SELECT * FROM lexicon_answers")
def cat4(spark, sf):
    items = views.exploded(spark, sf).select("item_id", "kind", "text")
    return classify.classify_by_lexicon(items, views.LEXICON).drop("text")


def _sql_words(words) -> str:
    return views.sql_list(words)


def _sql_count(tokens: str, words) -> str:
    return f"len(list_filter({tokens}, lambda w: list_contains({_sql_words(words)}, w)))"


_TOKENS = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+')"
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "cat5_analyse_threads",
    f"""WITH parts AS (SELECT doc_id, {_TOKENS.format("text")} AS tokens, {_SENTENCES} AS sentences FROM documents),
    counted AS (SELECT *, {_sql_count("tokens", vocab.POSITIVE_CUES)} AS pos,
                       {_sql_count("tokens", vocab.NEGATIVE_CUES)} AS neg FROM parts)
    SELECT doc_id,
      array_to_string(list_filter(sentences, lambda s: list_has_any({_TOKENS.format("s")}, {_sql_words(vocab.PAIN_CUES)})), '|') AS pain_points,
      array_to_string(list_filter(sentences, lambda s: list_has_any({_TOKENS.format("s")}, {_sql_words(vocab.REQUEST_CUES)})), '|') AS feature_requests,
      CASE WHEN neg > pos THEN 'negative' WHEN pos > neg THEN 'positive' ELSE 'neutral' END AS sentiment,
      CASE WHEN {_sql_count("tokens", vocab.HIGH_PRIORITY_CUES)} > 0 THEN 'high'
           WHEN {_sql_count("tokens", vocab.MEDIUM_PRIORITY_CUES)} > 0 THEN 'medium' ELSE 'low' END AS priority,
      CASE WHEN {_sql_count("tokens", vocab.DEVELOPER_CUES)} > 0 THEN 'developer' ELSE 'general' END AS user_type
    FROM counted""",
)
def cat5(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    analysed = classify.analyse_threads(docs, F.col("text"))
    return analysed.select(
        "doc_id",
        F.array_join("pain_points", "|").alias("pain_points"),
        F.array_join("feature_requests", "|").alias("feature_requests"),
        "sentiment",
        "priority",
        "user_type",
    )


def by_counting():
    """A user's analyser, as plain as can be: lines by their lengths."""

    def analyse(pages: list[dict]) -> list[dict]:
        found = []
        for page in pages:
            lines = page["text"].split("\n")
            found.append(
                {
                    "pain_points": [x for x in lines if len(x) % 3 == 0],
                    "feature_requests": [x for x in lines if len(x) % 3 == 1],
                    "sentiment": "positive" if len(lines) % 2 else "negative",
                    "priority": ("high", "medium", "low", "none")[len(page["text"]) % 4],
                    "user_type": "last" if page["page"] + 1 == page["n_pages"] else "other",
                    "prompt_tokens": len(page["text"]),
                }
            )
        return found

    return analyse


@query(
    "cat5_user_analyser",
    """WITH parts AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    cut AS (SELECT doc_id, i, unnest(range((length(line) + 199) // 200)) AS k, line FROM parts WHERE regexp_matches(line, '\\S')),
    pieces AS (SELECT doc_id, substr(line, k * 200 + 1, 200) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS pos FROM cut),
    paged AS (
      SELECT doc_id, pos // 4 AS page, count(*) AS n, string_agg(piece, chr(10) ORDER BY pos) AS text FROM pieces GROUP BY ALL),
    told AS (
      SELECT *, CASE WHEN n % 2 = 1 THEN 'positive' ELSE 'negative' END AS sentiment, length(text) % 4 AS rank,
        CASE WHEN page = max(page) OVER (PARTITION BY doc_id) THEN 'last' ELSE 'other' END AS user_type FROM paged),
    points AS (SELECT doc_id, length(piece) % 3 AS kind, piece, min(pos) AS pos FROM pieces GROUP BY ALL),
    lists AS (
      SELECT doc_id, string_agg(piece, '|' ORDER BY pos) FILTER (kind = 0) AS pain_points,
             string_agg(piece, '|' ORDER BY pos) FILTER (kind = 1) AS feature_requests FROM points GROUP BY 1),
    summed AS (
      SELECT doc_id, count(*) AS n_pages, sum(length(text)) AS prompt_tokens, min(rank) AS rank,
        2 * count(*) FILTER (sentiment = 'positive') > count(*) AS cheerful, 2 * count(*) FILTER (user_type = 'last') >= count(*) AS ends
      FROM told GROUP BY 1)
    SELECT doc_id, coalesce(pain_points, '') AS pain_points, coalesce(feature_requests, '') AS feature_requests,
      CASE WHEN cheerful THEN 'positive' WHEN NOT cheerful THEN 'negative' END AS sentiment,
      ['high', 'medium', 'low', NULL][rank + 1] AS priority, CASE WHEN ends THEN 'last' WHEN NOT ends THEN 'other' END AS user_type,
      coalesce(n_pages, 0) AS n_pages, CAST(prompt_tokens AS BIGINT) AS prompt_tokens
    FROM documents LEFT JOIN lists USING (doc_id) LEFT JOIN summed USING (doc_id)""",
)
def cat5_user(spark, sf):
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.struct(line.alias("cleaned_body")))
    docs = views.table(spark, sf, "documents").select("doc_id", lines.alias("comments"))
    found = analyser.analyse_with(docs, by_counting(), ["doc_id"], comments=4, characters=200)
    lists = [F.array_join(n, "|").alias(n) for n in ("pain_points", "feature_requests")]
    return found.select("doc_id", *lists, "sentiment", "priority", "user_type", "n_pages", "prompt_tokens")

"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.binding import let
from voxmill.llm.common import GAPS, UPPER, semi_join, with_key, words
from voxmill.session import stored_once

SYMBOLS = "#*$%&|<>"
#: Each rule: a measure, and the cutoffs it may have; a document above the cutoff goes.
#: They are set here, before any label is seen, so every label may serve as holdout.
RULES = {
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0),
    "dup_lines": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeats": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "capitals": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
    "word_length": (5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0),
}
#: Share of good documents of a stratum that all rules together may reject, and the chance
#: that a promise about any stratum is broken.
RISK, DOUBT = 0.05, 0.05


def _twice(hashes: Column) -> Column:
    """Rising places of the hashes that come twice or more."""

    def places(placed: Column) -> Column:
        return F.sort_array(F.filter(
            F.transform(
                placed,
                lambda x, k: F.when((F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"]),
            ),
            lambda i: i.isNotNull(),
        ))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)


def _repeat_words(tokens: Column) -> Column:
    """Words covered by 3-word windows that come twice or more. ``tokens`` is bound."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 3),
        lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        return F.aggregate(
            _twice(hashes), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(tokens) < 4, 0).otherwise(some)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of every whole text, and the measures that the rules look at, a row for each
    row of ``docs``. A null text has no words."""
    rows = with_key(docs.withColumn("_stratum", F.col(stratum_col).cast("string")), id_col, text_col, "_stratum")
    rows = rows.select("doc_id", "tkey", F.col("_stratum").alias("stratum"), F.col("text").alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    # lambdas name the words often: bound, they are split once
    of_words = let(words(F.col("_t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    chars = F.length(F.translate("_t", GAPS, ""))
    without = lambda signs: (F.length("_t") - F.length(F.translate("_t", signs, ""))).cast("long")
    rows = rows.select("doc_id", "tkey", "stratum", F.struct(
        of_words.alias("w"), of_lines.alias("l"), chars.cast("long").alias("chars"), without(SYMBOLS).alias("symbols"), without(UPPER).alias("capitals"),
    ).alias("_c"))
    rows = rows.select(
        "doc_id", "tkey", "stratum", F.col("_c.w.n").alias("n_words"), F.col("_c.chars").alias("word_chars"), F.col("_c.symbols").alias("n_symbols"),
        F.col("_c.l").alias("_lines"), F.col("_c.w.repeat").alias("n_repeat_words"), F.col("_c.capitals").alias("n_capitals"),
    )
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return rows.select(
        "doc_id", "tkey", "stratum", "n_words", "word_chars", "n_symbols",
        F.col("_lines.dup").alias("n_dup_lines"), "n_repeat_words",
        F.struct(
            (F.col("n_symbols") / n).alias("symbols"),
            (F.col("_lines.dup") / F.greatest("_lines.n", F.lit(1))).alias("dup_lines"),
            (F.col("n_repeat_words") / n).alias("repeats"),
            (F.col("n_capitals") / chars).alias("capitals"),
            (F.col("word_chars") / n).alias("word_length"),
        ).alias("measures"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, brought back down; good to about 1e-12."""
    x = n.cast("double") + 10.0
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    down = sum((F.log(n.cast("double") + float(i)) for i in range(1, 11)), F.lit(0.0))
    return series - down


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial in n and p where k <= n p, else 1.

    Terms are added from k downward until they are too small for a double to see, which
    takes about the square root of n p of them."""
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    low = F.greatest(F.lit(1).cast("long"), (k - F.ceil(12 * F.sqrt(n * p)) - 60).cast("long"))
    total = let(F.exp(first), lambda top: F.aggregate(
        F.when(k > 0, F.sequence(k, low)).otherwise(F.array().cast("array<bigint>")),
        F.struct(top.alias("term"), top.alias("sum")),
        lambda a, i: let(a["term"] * i * (1 - p) / ((n - i + 1) * p), lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum"))),
        lambda a: a["sum"],
    ))
    return F.when(k <= n * p, total).otherwise(1.0)


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, rules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(stratum, rule, cutoff): of each rule the lowest cutoff that is certified.

    For every stratum and rule, cutoffs are tested from the loosest to the strictest, up to
    the first that fails. Of n labelled good documents, k lie above the cutoff. If the true
    share of good documents above it were over ``risk`` / number of rules, so few would be
    seen with a chance of at most P(Bin(n, share) <= k). The test is passed where that chance
    is at most ``doubt`` divided by the number of strata and rules (Bonferroni). Tests in a
    fixed order that end with the first failure need no correction among themselves: a false
    promise takes a false pass at the first cutoff that deserves none. So with probability 1 - ``doubt``
    no stratum loses more than ``risk`` of its good documents. Too few labels certify nothing:
    with five rules and four strata it takes 597 good documents of a stratum.

    A document with several labels is good only if all say so; null labels are no labels.
    Documents that repeat an id all count.
    """
    rules = rules or RULES
    good = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality")).filter("quality = 1 AND labelled IS NOT NULL")
    rows = measured.select("doc_id", "stratum", "measures").join(good, F.col("doc_id") == F.col("labelled"))
    tested = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"measures.{name}").alias("value"), F.lit(c).alias("cutoff")) for name, cuts in rules.items() for c in cuts))
    counts = rows.select("stratum", F.inline(tested)).groupBy("stratum", "rule", "cutoff").agg(
        F.count("*").alias("n"), F.sum((F.col("value") > F.col("cutoff")).cast("long")).alias("k")
    )
    counts = stored_once(counts, "holdout")
    tests = max(counts.select("stratum", "rule").distinct().count(), 1)
    passed = binomial_tail(F.col("n"), F.col("k"), risk / len(rules)) <= doubt / tests
    chains = counts.withColumn("passed", passed).groupBy("stratum", "rule").agg(
        F.max(F.when(~F.col("passed"), F.col("cutoff"))).alias("failed"), F.collect_list("cutoff").alias("cutoffs")
    )
    certified = F.array_min(F.filter("cutoffs", lambda c: F.col("failed").isNull() | (c > F.col("failed"))))
    return chains.select("stratum", "rule", certified.alias("cutoff")).filter("cutoff IS NOT NULL")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``failed_rules`` (array) and ``kept``: false if the base rules
    fail or a measure lies above its stratum's certified cutoff."""
    table = cutoffs.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cutoff")).alias("cutoffs"))
    table = stored_once(table.withColumnRenamed("stratum", "_stratum"), "cutoffs")
    rows = measured.join(table, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")

    def over(c: Column) -> Column:
        out = F.lit(False)
        for name in measured.schema["measures"].dataType.names:
            out = out | ((c["rule"] == name) & (F.col(f"measures.{name}") > c["cutoff"]))
        return out

    failed = F.coalesce(F.array_sort(F.transform(F.filter("cutoffs", over), lambda c: c["rule"])), F.array().cast("array<string>"))
    rows = rows.withColumn("failed_rules", failed).drop("cutoffs", "_stratum")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, **columns: str) -> DataFrame:
    """A row for each row of ``docs``: id, ``tkey``, counts, ``failed_rules`` and ``kept``.

    See :func:`certify` for the promise. The stratum is the language; a null one is a
    stratum of its own. Empty tables give empty results, rows that repeat give a row each, and
    other columns of ``docs`` are not looked at. Counts are made once and stored, a narrow
    row per document, for the certificate and for the verdicts.
    """
    measured = stored_once(measure(docs, **columns), "measured")
    return judge(measured, certify(measured, labels, risk, doubt))


def keep_good(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, with all their columns."""
    return semi_join(docs, verdicts.filter("kept"), id_col, text_col)

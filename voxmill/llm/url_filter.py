"""URL filters: host-suffix and path-prefix expressions joined to rules by hash prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.binding import let
from voxmill.llm.common import ascii_lower, in_struct, of_row

#: Hex digits of the digest that the join uses.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there
    up to ``?``, ``#`` or the end. Both are empty for a null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of their url.

    ``rules`` has host, path and verdict. A rule fits its host and that host's subdomains
    if the page's path starts with the rule's. The longest host and path wins; of equally
    long ones that with the longer host, then ``block``. Without a rule, ``rule`` is null
    and ``verdict`` is ``default``.

    Each different url is spread into its host suffixes and path prefixes that end in a
    slash (no deeper than the deepest rule), each hashed; the short hashes are joined, the
    whole digest and the rest of a rule's path confirm a hit. Verdicts are made once per
    url, so copies of a page cost one row.

    A null url or one without ``://`` has no host and fits no rule with a host. Rules with
    null parts and repeated rules are ignored. Columns of ``pages`` named like the four
    results are replaced. Empty tables give empty results.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna().distinct()
    rules = rules.withColumn("stem", F.regexp_extract("rule_path", r"^(?s:.*)/", 0))
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("stem", "/")))).first()
    labels, slashes = deepest[0] or 0, (deepest[1] or 1) - 1
    rules = rules.withColumn("digest", _digest(F.concat("rule_host", "stem"))).withColumn("short", F.substring("digest", 1, SHORT))

    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    suffixes = let(F.split("host", r"\."), lambda names: F.transform(
        F.sequence(F.greatest(F.size(names) - labels + 1, F.lit(1)), F.size(names)),
        lambda i: F.concat_ws(".", F.slice(names, i, F.size(names))),
    ))
    stems = let(F.split("path", "/"), lambda parts: F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(slashes))),
        lambda i: F.when(i == 0, "").otherwise(F.concat(F.concat_ws("/", F.slice(parts, 1, i)), F.lit("/"))),
    ))
    spread = urls.select("url", "host", "path", F.explode(suffixes).alias("suffix")).select("url", "path", "suffix", F.explode(stems).alias("stem_"))
    spread = spread.select("url", "path", _digest(F.concat("suffix", "stem_")).alias("url_digest")).withColumn("url_short", F.substring("url_digest", 1, SHORT))
    hits = spread.join(rules, F.col("url_short") == F.col("short")).filter("url_digest = digest AND startswith(path, rule_path)")
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("url").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), rule.alias("rule"), "rule_verdict")).alias("best")
    )
    page = of_row(url_col)
    host, path = host_and_path(page)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = in_struct(pages, kept).join(best.withColumnRenamed("url", "judged"), page == F.col("judged"), "left")
    return judged.select(
        *(of_row(c).alias(c) for c in kept), host.alias("host"), path.alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )

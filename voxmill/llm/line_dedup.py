"""Line deduplication by an exact set-similarity join over the words of lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.binding import let
from voxmill.llm.common import GAPS, in_struct, of_row, text_key, with_key, words
from voxmill.session import drop_stored, stored_once

#: Counters for word frequencies: words share a counter by their hash. More counters tell
#: rare words apart in a larger corpus; links do not depend on it.
COUNTERS = 1 << 20
#: Bits of a word's key that hold its hash; above them is its frequency's logarithm.
_HASH_BITS = 57
_CLASS = ("c1", "parity", "n")


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "tkey", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _line_words(line: Column) -> Column:
    """The words of a line. One with single spaces alone is cut at them, which is much
    cheaper than the pattern for any white space."""
    rare = [F.contains(line, F.lit(gap)) for gap in (*GAPS.replace(" ", ""), "  ")]
    trimmed = F.trim(line)
    plain = (trimmed != "") & ~reduce(or_, rare)
    return F.when(plain, F.split(trimmed, " ")).otherwise(words(line))


def _levels(lines: DataFrame, counters: int) -> DataFrame:
    """How frequent the words of each counter are: an array of logarithms in the bits above
    a word's hash, by counter. It is counted once and stored as one row of ``counters``
    numbers."""
    counts = lines.select(F.explode(_line_words(F.col("line"))).alias("w")).groupBy(_counter(F.col("w"), counters).alias("at")).count()
    every = lines.sparkSession.range(counters).join(counts, F.col("id") == F.col("at"), "left")
    level = _shifted(F.floor(F.log2(F.coalesce("count", F.lit(1)))), F.lit(_HASH_BITS))
    by_id = F.sort_array(F.collect_list(F.struct("id", level.alias("level"))))
    return stored_once(every.agg(by_id["level"].alias("levels")), "levels")


def _counter(word: Column, counters: int) -> Column:
    """The counter of a word; ``counters`` is a power of two."""
    return F.hash(word).bitwiseAND(F.lit(counters - 1))


def _keys(line: Column, levels: Column, counters: int) -> Column:
    """The different words of a line as numbers, the rarest first. ``levels`` is a column of
    the rows (see ``_with_levels``), named once. Little is done per word, since a lambda is
    not compiled; without nulls the numbers are told apart and sorted as plain longs."""
    mask = F.lit((1 << _HASH_BITS) - 1)

    def key(word: Column) -> Column:
        level = F.coalesce(F.get(levels, _counter(word, counters)), F.lit(0).cast("long"))
        return level.bitwiseOR(F.xxhash64(word).bitwiseAND(mask))

    return F.sort_array(F.array_distinct(F.transform(_line_words(line), key)))


def _with_levels(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """The optimizer joins this projection with the next one, so the table of levels stays
    one object per task and is in no row."""
    return lines.withColumn("levels", levels.scalar())


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _prefix(keys: Column, num: int, den: int) -> Column:
    n = F.size(keys)
    return F.slice(keys, 1, F.greatest(n - F.ceil(n * num / F.lit(den)).cast("int") + 1, F.lit(1)))


def _told(keys: Column, num: int, den: int) -> list[Column]:
    """What stands for a word set: its size, two hashes, and its rarest words."""
    one, low = F.lit(1).cast("long"), F.lit(63)
    parity = F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(_shifted(one, k.bitwiseAND(low).cast("int"))))
    return [F.size(keys).alias("n"), F.xxhash64(keys).alias("c1"), parity.alias("parity"), _prefix(keys, num, den).alias("prefix")]


def _near(a: str, b: str, num: int, den: int, parity: bool) -> Column:
    """Length, positional and parity filters of two postings with a common word: if it is
    the first one that they share, they may still be similar enough."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    wanted = F.ceil((n + m) * num / F.lit(num + den))
    left = 1 + F.least(n - 1 - F.col(f"{a}.at"), m - 1 - F.col(f"{b}.at"))
    fits = (den * n >= num * m) & (den * m >= num * n) & (left >= wanted)
    if parity:
        fits = fits & (F.bit_count(F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity"))) <= n + m - 2 * wanted)
    return fits


def _verified(later: DataFrame, earlier: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Classes of ``later`` that are similar to an earlier one with a common word. Pairs are
    stored before whole sets meet, so disk never holds the postings and the sets at once."""
    a, b = later.alias("a"), earlier.alias("b")
    pairs = a.join(b, (F.col("a.word") == F.col("b.met")) & (F.col("b.first") < F.col("a.first")) & _near("a", "b", num, den, True))
    pairs = pairs.select(*(F.col(f"a.{c}") for c in _CLASS), *(F.col(f"b.{c}").alias(f"other_{c}") for c in _CLASS)).distinct()
    pairs = stored_once(pairs, "pairs")
    mine = sets.select(*_CLASS, F.col("keys").alias("mine"))
    theirs = sets.select(*(F.col(c).alias(f"other_{c}") for c in _CLASS), F.col("keys").alias("theirs"))
    both = F.size(F.array_intersect("mine", "theirs"))
    met = pairs.join(mine, list(_CLASS)).join(theirs, [f"other_{c}" for c in _CLASS])
    similar = stored_once(met.filter(den * both >= num * (F.size("mine") + F.size("theirs") - both)).select(*_CLASS).distinct(), "similar")
    drop_stored(pairs)
    return similar


def similar_lines(docs: DataFrame, num: int = 80, den: int = 100, least: int = 1, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, line_no) of every line that goes.

    Two lines are similar if den * |common words| >= num * |all words| for the sets of
    their words. A line goes if a similar one stands earlier: in a document of smaller id,
    or higher up in its own, whether that one stays or not. Lines of fewer than ``least``
    different words are not judged and stay; by default these are the lines without words.

    Words are compared by 57 bits of a hash. Lines of one word set are one class. Words are
    ordered by frequency, rarest first (the frequency by hashed counters over all lines, so
    the order is a bounded table and needs no join; ``counters`` is a power of two). Similar
    sets share one of their first n - ceil(n num / den) + 1 words. A semi-join, which gives
    a row at most for a class, asks with length, position and parity of the sets whether a
    class may have a partner at all; few have. Sets so short that only an equal one is
    similar are settled by their class and take no part in it. Of these the whole sets are fetched. They
    are compared with the earliest class of each of their prefix words, and only those that
    this does not settle with all earlier ones, so large groups of similar lines do not
    multiply. Lines that repeat a class are named before any sets are compared; from then on
    a class is its first line, and of each step's tables only what the next ones read stays.
    """
    rows = with_key(docs, id_col, text_col)
    lines = _lines(rows)
    levels = _levels(lines, counters)
    keyed = _with_levels(lines, levels).select("doc_id", "tkey", "line_no", _keys(F.col("line"), F.col("levels"), counters).alias("keys"))
    keyed = keyed.select("doc_id", "tkey", "line_no", *_told(F.col("keys"), num, den))
    stored = stored_once(keyed, "lines")
    keyed = stored.filter(F.col("n") >= least)  # only now, or the keys are computed twice

    place = F.struct("doc_id", "tkey", "line_no")
    grouped = keyed.groupBy(*_CLASS).agg(F.min(place).alias("first"), F.count("*").alias("times"), F.any_value("prefix").alias("prefix"))
    firsts = stored_once(grouped, "firsts")
    again = keyed.select("doc_id", "tkey", "line_no", *_CLASS).join(firsts.filter("times > 1").select(*_CLASS, "first"), list(_CLASS))
    copies = stored_once(again.filter(F.col("first") < place).select("doc_id", "tkey", "line_no"), "copies")
    drop_stored(stored)

    others = firsts.filter(den * F.col("n") >= num * (F.col("n") + 1))  # n words and one more at best
    postings = others.select(*_CLASS, F.posexplode("prefix").alias("at", "word"))
    a, b = postings.alias("a"), postings.alias("b")
    other = (F.col("a.word") == F.col("b.word")) & ((F.col("a.c1") != F.col("b.c1")) | (F.col("a.parity") != F.col("b.parity")) | (F.col("a.n") != F.col("b.n")))
    maybe = stored_once(a.join(b, other & _near("a", "b", num, den, True), "left_semi").select(*_CLASS).distinct(), "maybe")
    suspects = stored_once(firsts.join(maybe, list(_CLASS), "left_semi").select(*_CLASS, "first", "first.*"), "suspects")
    drop_stored(firsts, maybe)

    homes = suspects.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.collect_list(F.struct("line_no", *_CLASS, "first")).alias("own"))
    homes = stored_once(homes, "homes")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key"))
    theirs = rows.join(homes, same).select(F.inline(let(F.split("text", "\n"), lambda all_lines: F.transform(
        "own", lambda x: F.struct(*(x[c].alias(c) for c in (*_CLASS, "first")), F.get(all_lines, x["line_no"]).alias("line"))
    ))))
    theirs = _with_levels(theirs.select(*_CLASS, "first", "line"), levels)
    sets = stored_once(theirs.select(*_CLASS, "first", _keys(F.col("line"), F.col("levels"), counters).alias("keys")), "sets")
    drop_stored(suspects, homes, levels)

    few = sets.select(*_CLASS, "first", F.posexplode(_prefix(F.col("keys"), num, den)).alias("at", "word"))
    hubs = few.groupBy("word").agg(F.min(F.struct("first", *_CLASS, "at")).alias("b")).select(F.col("word").alias("met"), "b.*")
    gone = _verified(few, hubs, sets, num, den)
    rest = few.join(gone, list(_CLASS), "left_anti")
    more = _verified(rest, few.withColumnRenamed("word", "met"), sets, num, den)

    led = sets.join(gone.union(more), list(_CLASS), "left_semi").select("first.*")
    goes = stored_once(copies.union(led.select("doc_id", "tkey", "line_no")), "goes")
    drop_stored(copies, sets, gone, more)
    return goes


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """``docs`` without the lines that :func:`similar_lines` names, and with ``n_lines`` and
    ``n_lines_gone``; all rows and columns stay, columns of these two names are replaced.

    What is left of a text is its other lines, joined by line feeds. A null text stays null
    and has no lines. Rows of one id and one text are one document, and lose the same
    lines; of rows with one id and different texts the lower hash of the text counts as
    earlier. A null id is the smallest. An empty table stays empty.
    """
    goes = similar_lines(docs, id_col=id_col, text_col=text_col, **settings)
    goes = goes.dropDuplicates().groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_lines_gone")]
    own = of_row(text_col)
    rows = in_struct(docs, kept).join(goes, of_row(id_col).eqNullSafe(F.col("_id")) & (text_key(own) == F.col("_key")), "left")
    n_gone = F.coalesce(F.size("_gone"), F.lit(0))
    left = let(F.split(own, "\n"), lambda lines: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i)), "\n"
    ))
    text = F.when(n_gone > 0, left).otherwise(own)
    return rows.select(
        *((text if c == text_col else of_row(c)).alias(c) for c in kept),
        F.when(own.isNull(), 0).otherwise(F.size(F.split(own, "\n"))).cast("long").alias("n_lines"),
        n_gone.cast("long").alias("n_lines_gone"),
    )

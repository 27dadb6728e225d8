"""Spelling variants: words one edit apart, found by PartEnum signatures of letter multisets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from voxmill.session import stored_once

#: Parts of the letters' domain. Two words that are near differ in at most two of them.
PARTS = 4
#: A worker hands its counts on at so many different words.
WORDS_HELD = 200_000
#: What a signature is for: words of one length, or the shorter or longer of two lengths.
SAME, SHORTER, LONGER = 0, 1, 2


def _counter(least: int, drop_every: int | None):
    run = re.compile(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                begun = crc32(f"{ident.as_py()}:".encode())
                # Bytes, since their lower case is that of A-Z alone.
                for word, n in Counter(run.findall(text.as_py().encode().lower().decode())).items():
                    if drop_every is not None:
                        h = crc32(word.encode(), begun)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    counts[word] += n
                if len(counts) >= WORDS_HELD:
                    yield handed_on()
        yield handed_on()

    return count


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, drop_every: int | None = None) -> DataFrame:
    """(word, n) of all runs of at least ``least`` Latin letters, A-Z in lower case.

    With ``drop_every`` a run loses one letter where a checksum of id and run says so: a
    known share of misspellings. Counts are combined in the worker, then before the shuffle.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_counter(least, drop_every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Features(dict):
    """(letter, how many of it came before) -> (its part, a 64-bit number for it)."""

    def __missing__(self, key: tuple[str, int]) -> tuple[int, int]:
        h = xxh3_64_intdigest(f"{key[0]}{key[1]}")
        self[key] = found = (h % PARTS, xxh3_64_intdigest(h.to_bytes(8, "big")))
        return found


def part_sums(words: list[str]) -> np.ndarray:
    """A row per word: for every part the sum (mod 2^64) of the features the word has there.

    A word's letters are a binary vector over (letter, occurrence): a replaced letter
    changes two places of it, an inserted or deleted one changes one."""
    features, sums = _Features(), [[0] * PARTS for _ in words]
    for word, own in zip(words, sums):
        met: dict[str, int] = {}
        for letter in word:
            k = met[letter] = met.get(letter, -1) + 1
            part, value = features[letter, k]
            own[part] += value
    mask = (1 << 64) - 1
    return np.array([[x & mask for x in own] for own in sums], np.uint64).reshape(len(words), PARTS)


def signatures(words: list[str]) -> tuple[np.ndarray, list[int]]:
    """(key per word and signature, what each signature is for).

    Words of one length that are near agree outside two parts, words of lengths m and m + 1
    outside one, and either the first half of both or the rest is the same. A signature is
    the sum over the other parts, hashed with the length, the parts left out and that half."""
    sums = part_sums(words)
    total = sums.sum(axis=1, dtype=np.uint64)
    pairs = list(combinations(range(PARTS), 2))
    keys, kinds = [], []

    def add(kind: int, lengths: list[int], halves: list[str], left_out: tuple[int, ...], side: int) -> None:
        rest = total - sum(sums[:, p] for p in left_out)
        tag = (kind == SAME, left_out, side)
        base = [xxh3_64_intdigest(f"{tag}{m}|{half}") for m, half in zip(lengths, halves)]
        mixed = (rest ^ np.array(base, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(mixed ^ (mixed >> np.uint64(29)))
        kinds.append(kind)

    for kind, parts in ((SAME, pairs), (SHORTER, [(p,) for p in range(PARTS)]), (LONGER, [(p,) for p in range(PARTS)])):
        lengths = [len(w) - (kind == LONGER) for w in words]
        first = [w[: m // 2] for w, m in zip(words, lengths)]
        rest = [w[m // 2 + (kind == LONGER) :] for w, m in zip(words, lengths)]
        for left_out in parts:
            add(kind, lengths, first, left_out, 0)
            add(kind, lengths, rest, left_out, 1)
    return np.stack(keys, axis=1).view(np.int64), kinds


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        keys, kinds = signatures(words)
        at = np.repeat(np.arange(len(words)), len(kinds))
        kind = np.tile(np.array(kinds, np.int8), len(words))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(kind), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["key", "kind", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of all pairs of ``words`` (word, n; words distinct) that differ by
    one inserted, deleted or replaced code point; each pair once.

    Signatures meet in an equi-join; what shares one is verified there, so only true pairs
    come out of it. A bucket holds different words with one half and most letters in common.
    """
    postings = words.select("word", "n").mapInArrow(_postings, "key bigint, kind byte, word string, n bigint")
    a, b = postings.alias("a"), postings.alias("b")
    same = (F.col("a.kind") == SAME) & (F.col("b.kind") == SAME) & (F.col("a.word") < F.col("b.word"))
    longer = (F.col("a.kind") == SHORTER) & (F.col("b.kind") == LONGER)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (same | longer) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last. Every step of the loop
    doubles the reach, and each form is commoner than its word by a factor, so the steps
    are few; each is written to the shared folder."""
    reach = stored_once(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = stored_once(reach.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if reach.filter("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def group_spellings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_count: int = 2, times: int = 10,
    drop_every: int | None = None,
) -> DataFrame:
    """A row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are those of :func:`count_words` that occur ``least_count`` times over all whole
    texts. Near words differ by exactly one code point put in, left out or replaced. A
    word's form is its most frequent near word (of equal ones the first in code-point
    order) if that is ``times`` as frequent as the word, else null; ``root`` follows forms
    to the last and is the word itself where it has none.

    Null and empty texts have no words; a null id counts as the empty text in the checksum;
    repeated rows count as often as they come; an empty table gives no rows. Other columns of
    ``docs`` are not looked at, so their names can't clash. A run of any length is one word:
    each of its 36 signatures carries it.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    words = count_words(docs, id_col, text_col, least, drop_every).filter(F.col("n") >= least_count)
    words = stored_once(words, "words")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    near = pairs.select(both.alias("p")).select("p.*")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    fits = -F.col("best.minus") >= times * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"),
    )
    judged = stored_once(judged, "near")
    last = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

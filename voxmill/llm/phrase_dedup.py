"""Repeated phrases located by sharded Aho-Corasick automata over words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from voxmill.llm.common import spaced
from voxmill.llm.repeats import Method, Segment, find_repeats, merged
from voxmill.llm.shingle_join import mixed
from voxmill.llm.suffix_dedup import _signed

#: The first code point that stands for a word, and the surrogates that must not.
_FIRST, _GAP, _GAP_SIZE = 0x100, 0xD800, 0x800


def word_hashes(tokens: list[bytes], gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` words."""
    n = len(tokens) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mixed(np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens)))
    out = h[:n].copy()
    for k in range(1, gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


def solve_words(segments: list[Segment], size: int) -> list[tuple]:
    """Rows of a shard (see ``repeats``): of equal phrases all but the first go.

    Every word of the shard gets a character of its own, so a phrase of ``size`` words is a
    string of ``size`` characters. Phrases that come twice are confirmed by counting; an
    automaton of them walks over all segments and tells every place where one ends.
    """
    import ahocorasick

    segments = sorted({s.place: s for s in segments}.values(), key=lambda s: s.place)
    letters: dict[bytes, str] = {}
    strings = []
    for s in segments:
        own = []
        for word in s.body.split():
            letter = letters.get(word)
            if letter is None:
                code = _FIRST + len(letters)
                letter = letters[word] = chr(code + _GAP_SIZE if code >= _GAP else code)
            own.append(letter)
        strings.append("".join(own))
    counts = Counter(t[k : k + size] for t in strings for k in range(len(t) - size + 1))
    again = ahocorasick.Automaton()
    for phrase, n in counts.items():
        if n > 1:
            again.add_word(phrase, phrase)
    rows: list[tuple] = []
    if len(again):
        again.make_automaton()
        met: set[str] = set()
        for s, t in zip(segments, strings):
            run: list[int] | None = None
            for end, phrase in again.iter(t):
                lo = s.at + end + 1 - size
                if phrase not in met:  # segments come in the order of their places
                    met.add(phrase)
                    continue
                if run and lo <= run[1]:
                    run[1] = lo + size
                else:
                    if run:
                        rows.append((0, s.doc_id, s.tkey, *run, 0, 0))
                    run = [lo, lo + size]
            if run:
                rows.append((0, s.doc_id, s.tkey, *run, 0, 0))
    if any(s.blocks > 1 for s in segments):
        told: set[str] = set()
        for s, t in zip(segments, strings):
            if s.blocks == 1:
                continue
            tokens = s.body.split()
            for k in range(len(t) - size + 1):
                phrase = t[k : k + size]
                if phrase not in told:
                    told.add(phrase)
                    digest = xxh3_128_intdigest(b" ".join(tokens[k : k + size]))
                    rows.append((1, s.doc_id, s.tkey, s.at + k, s.at + k + size, _signed(digest >> 64), _signed(digest)))
    return rows


def _split(text: str) -> list[bytes]:
    return text.encode().split()


def _method(size: int) -> Method:
    return Method(
        size=size, gram=max(1, 2 * size // 5), units=_split, hashes=word_hashes, body=lambda tokens, lo, hi: b" ".join(tokens[lo:hi]),
        solve=lambda segments: solve_words(segments, size), shard_bytes=1 << 18, first_stays=True,
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans_out, kept_out, digests = [], [], []
        for text, spans in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            tokens = _split(text)
            gone = merged([(s["lo"], s["hi"]) for s in spans or ()])
            kept, at = [], 0
            for lo, hi in gone:
                kept += tokens[at:lo]
                at = hi
            left = b" ".join(kept + tokens[at:])
            spans_out.append([{"lo": lo, "hi": hi} for lo, hi in gone])
            kept_out.append(left.decode() if gone else None)
            digests.append(hashlib.sha256(left).hexdigest())
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(spans_out, kind), pa.array(kept_out, pa.string()), pa.array(digests, pa.string())],
            names=["doc_id", "tkey", "n_words", "spans", "kept", "kept_sha256"],
        )


def drop_repeated_phrases(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, n_words, spans, kept, kept_sha256) of every row of ``docs``.

    A word goes if a phrase of ``size`` words that covers it also starts earlier: in a
    document of smaller id, or earlier in the same one. ``spans`` are the runs of words that
    go (``lo`` to before ``hi``), ``kept`` is what is left of a text that loses something,
    its words joined by one space (null: the text stays as it is), ``kept_sha256`` the
    digest of the words that are left, joined so.

    Phrases are compared word by word (see :func:`solve_words`) among the stretches whose
    anchors come again (see ``repeats``); only for anchors with more than a block of
    segments are phrases of different blocks compared by 128-bit digests.

    Null, empty and blank texts have no words. Rows with one id and one text are one
    document; of rows with one id and different texts, one that hashes lower counts as
    earlier. A null id is the smallest. Other columns are not looked at. An empty table
    gives an empty result.
    """
    own = spaced(F.col("text"))
    n_words = F.when(own == "", 0).otherwise(F.octet_length(own) - F.octet_length(F.replace(own, F.lit(" "), F.lit(""))) + 1)
    settled, compared = find_repeats(docs, _method(size), n_words, F.sha2(own, 256), id_col, text_col)
    shape = "doc_id bigint, tkey bigint, n_words bigint, spans array<struct<lo:bigint,hi:bigint>>, kept string, kept_sha256 string"
    spans = F.when(F.col("gone"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    easy = settled.select(
        "doc_id", "tkey", F.col("n").alias("n_words"), spans.alias("spans"), F.when(F.col("gone"), F.lit("")).alias("kept"),
        F.when(F.col("gone"), F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    return easy.union(compared.mapInArrow(_cut, shape))

"""Packing token streams into sequences by an order-preserving dynamic program."""

from __future__ import annotations

from codecs import charmap_decode
from collections.abc import Iterator
from operator import itemgetter
from string import punctuation
from struct import pack as pack_numbers
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import text_key

#: Cost of a cut, in tokens of padding: at the end of a document, of a sentence, elsewhere.
CUT_DOC, CUT_SENTENCE, CUT_INSIDE = 0, 16, 64
#: Inside a sentence, a cut may also fall at every so many tokens of it.
INSIDE_STEP = 256
#: Sentences that end within so many tokens of the last place for a cut are passed over.
NEAREST = 16
#: A task packs its documents in blocks of about so many tokens (its memory).
BLOCK_TOKENS = 1 << 21
#: Words of up to so many bytes are remembered, so many of them per worker as they stand in
#: texts, and so many in lower case without the marks behind them.
WORD_BYTES, WORDS_KEPT, STEMS_KEPT = 64, 500_000, 500_000
#: Marks that the tokenizer never joins with the letters before them: all of ASCII but the
#: apostrophe.
MARKS = punctuation.replace("'", "")
#: The one letter that Python puts into lower case by what stands around it.
SIGMA = "\u03a3"
_ENDS = b".!?"
_last = itemgetter(-1)
_IS_END = np.isin(np.arange(256), list(_ENDS))


def sequence_cost(length: int, size: int) -> int:
    """Padding of a sequence: none at a power of two, else up to ``size``."""
    return 0 if length & (length - 1) == 0 else size - length


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Indexes into ``at`` of the cuts that cost least in padding and cut penalties.

    ``at`` has the places (rising, from 0 to the end, no gap above ``size``) where a cut may
    fall, ``cost`` the penalty of each. The cheapest way to reach a place p from a place q
    is cost(q) + q + size - p, so the best q among the last ``size`` tokens is the head of
    a monotone queue; sequences whose length is a power of two need no padding and are
    looked at by themselves. Of equal ways the one with the longest last sequence is
    taken, padded ones before unpadded.
    """
    n = len(at)
    places, penalties = at.tolist(), cost.tolist()
    exact: dict[int, list[int]] = {}
    for k in range(size.bit_length()):
        back = at - (1 << k)
        found = np.searchsorted(at, back)
        for j in np.nonzero(at[np.minimum(found, n - 1)] == back)[0].tolist():
            exact.setdefault(j, []).append(int(found[j]))
    reach, origin = [0] * n, [0] * n
    values, indexes, head = [0], [0], 0  # the queue: cost + place, rising, and the index
    for j in range(1, n):
        p = places[j]
        while places[indexes[head]] < p - size:
            head += 1
        source = indexes[head]
        best = values[head] + size - p
        if j in exact:
            for i in exact[j]:
                if reach[i] < best:
                    best, source = reach[i], i
        best += penalties[j]
        reach[j], origin[j] = best, source
        best += p
        while len(values) > head and values[-1] > best:
            values.pop()
            indexes.pop()
        values.append(best)
        indexes.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = origin[j]
    return cuts[::-1]


def _byte_letters() -> str:
    """The characters that stand for bytes in a byte-level vocabulary: a printable Latin-1
    character for itself, the others in turn for those from 256 on."""
    own = [33 <= b <= 126 or 161 <= b <= 255 and b != 173 for b in range(256)]
    spare = iter(range(256, 512))
    return "".join(chr(b if own[b] else next(spare)) for b in range(256))


class _Words(dict):
    """Token ids of words as little-endian 32-bit numbers, looked up once per word.

    The tokenizer puts text into lower case, character by character, and cuts letters from
    marks, so a word of letters with marks behind it is looked up as these two parts if it
    is still all letters then (some letters turn into a letter and a mark, which goes with
    the punctuation). A part of letters goes to the tokenizer's model as it is; anything
    else takes the whole way through the tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.stems: dict[str, bytes] = {}

    def _part(self, text: str, letters: bool) -> bytes:
        ids = self.stems.get(text)
        if ids is None:
            if letters:
                plain = text if text.isascii() else charmap_decode(text.encode(), "strict", self.letters)[0]
                found = [token.id for token in self.merge(plain)]
            else:
                found = self.encode(text, add_special_tokens=False).ids
            ids = pack_numbers(f"<{len(found)}I", *found)
            if len(text) <= WORD_BYTES:
                if len(self.stems) >= STEMS_KEPT:
                    self.stems.clear()
                self.stems[text] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(MARKS)
        lower = stem.lower() if stem.isascii() else normalize("NFC", stem).lower()
        if not (stem.isalpha() and lower.isalpha()):
            ids = self._part(text, False)
        else:
            ids = self._part(stem, False) if SIGMA in stem else self._part(lower, True)
            if len(stem) < len(text):
                ids += self._part(text[len(stem) :], False)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


_cache: dict[str, _Words] = {}


def words_of(path: str) -> _Words:
    """This worker's words of a tokenizer."""
    if path not in _cache:
        _cache[path] = _Words(path)
    return _cache[path]


def encode_sentences(text: bytes, words: _Words) -> tuple[bytes, list[int]]:
    """The ids of a text (UTF-8) as bytes, and the places (in ids) where its sentences end.

    The tokenizer drops white space and looks at each word by itself, so the ids of a text
    are those of its words in their order."""
    own = text.split()
    if not own:
        return b"", []
    parts = list(map(words.__getitem__, own))
    places = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    ends = _IS_END[np.frombuffer(bytes(map(_last, own)), np.uint8)]
    return b"".join(parts), (places[ends] // 4).tolist()


def _places(docs: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray]:
    at, cost, base = [0], [0], 0
    step, nearest = min(INSIDE_STEP, size), min(NEAREST, max(1, size // 64))
    for _, _, ids, ends in docs:
        last = 0
        n = len(ids) // 4
        for end in ends:
            for inside in range(last + step, end, step):
                at.append(base + inside)
                cost.append(CUT_INSIDE)
            if last + nearest <= end < n:
                at.append(base + end)
                cost.append(CUT_SENTENCE)
                last = end
        if n > last:
            for inside in range(last + step, n, step):
                at.append(base + inside)
                cost.append(CUT_INSIDE)
        base += n
        at.append(base)
        cost.append(CUT_DOC)
    return np.asarray(at, np.int64), np.asarray(cost, np.int64)


def pack_block(docs: list[tuple], size: int, first: int) -> list[tuple]:
    """Pieces (id, key, start, length, ids, doc_tokens, sequence, offset) of documents
    (id, key, ids, sentence ends). Every document must have an id or more."""
    at, cost = _places(docs, size)
    cuts = [int(at[j]) for j in best_cuts(at, cost, size)]
    pieces, sequence, begin, base = [], 0, 0, 0
    for ident, key, ids, _ in docs:
        n, start = len(ids) // 4, 0
        while start < n:
            end = min(n, cuts[sequence] - base)
            pieces.append((ident, key, start, end - start, ids[4 * start : 4 * end], n, first + sequence, base + start - begin))
            if base + end == cuts[sequence]:
                begin, sequence = cuts[sequence], sequence + 1
            start = end
        base += n
    return pieces


def _packer(path: str, size: int, end_id: int, block: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = words_of(path)
        last = np.asarray([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        docs: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, sequence
            pieces = pack_block(docs, size, sequence)
            sequence = pieces[-1][6] + 1
            docs, held = [], 0
            for k in range(0, len(pieces), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*pieces[k : k + 4096]), schema)], schema=schema
                )

        for batch in batches:
            for ident, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ends = encode_sentences(text, words)
                docs.append((ident, key, ids + last, ends))
                held += len(ids) // 4 + 1
                if held >= block:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    Documents are taken in the order in which they lie in the table, each with its ids and
    ``end_id``. Sequences are windows of that stream. They are cut at the ends of documents
    or sentences, and in long sentences, where padding and cut penalties together cost
    least. "Least" is over the places that are looked at: inside a long sentence every
    ``INSIDE_STEP`` tokens, and of sentence ends within ``NEAREST`` tokens the first. The
    stream is packed in blocks of about ``block_tokens``; a task packs the rows it reads,
    nothing is shuffled, and only the last sequence of a block is cut short.

    One row per piece: the id, ``tkey`` (hash of the text), ``start`` and ``length`` in the
    document's ids, ``ids`` (little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``
    and ``offset`` there. A null or empty text is ``end_id`` alone. Rows with one id are
    packed one by one. Other columns of ``docs`` are not looked at. ``tokenizer`` is the
    file of a tokenizer that drops white space.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, tkey bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    arrow = pa.schema([("doc_id", _arrow(docs, id_col)), ("tkey", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return rows.mapInArrow(_packer(tokenizer, size, end_id, block_tokens, arrow), schema)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def piece_digest() -> Column:
    """The checksum of a piece's ids."""
    return F.crc32("ids")

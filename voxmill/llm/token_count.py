"""Token counts of a unigram tokenizer by a count-only Viterbi pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import text_key
from voxmill.llm.packing import _arrow

#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words of up to so many bytes are remembered, so many of them per worker.
WORD_BYTES, WORDS_KEPT = 64, 400_000


def ranked_pieces(model: str) -> list[tuple[str, float]]:
    """(piece, score) of the pieces of a sentencepiece file that stand for text, in their
    order, scored as logarithms of Zipf's law by rank: the given files hold no unigram
    scores, and nothing is trained. Unknown, control, unused and byte pieces are no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    other = (sp.is_unknown, sp.is_control, sp.is_unused, sp.is_byte)
    return [(sp.id_to_piece(i), -math.log(i + 1.0)) for i in range(sp.get_piece_size()) if not any(is_(i) for is_ in other)]


def falls_back(model: str) -> bool:
    """Whether the file has a piece for each byte, by which unknown characters are written."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return sum(sp.is_byte(i) for i in range(sp.get_piece_size())) == 256


class Counter(dict):
    """word -> (tokens, unknown characters at its best cut), computed once per word.

    Ties as in common unigram tokenizers: places are walked from the left, a way to reach a
    place replaces another only if its score is higher, so of equal ways the one whose last
    piece begins first stays; a character that no one-character piece covers may be an
    unknown one. Unknown characters side by side are one token, or with ``by_bytes`` as many
    as they have UTF-8 bytes. Of the places walked, only as many are held as the longest
    piece has characters, however long a word is.
    """

    def __init__(self, pieces: list[tuple[str, float]], by_bytes: bool = False) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.by_bytes = by_bytes

    def count(self, word: str) -> tuple[int, int]:
        held = min(len(word), max(self.longest, 1)) + 1
        best, tokens, unknowns, fused = [0.0] * held, [0] * held, [0] * held, [False] * held
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        match = next(matches, None)
        for end, letter in enumerate(word):
            ways, single = [], False
            while match is not None and match[0] == end:
                ways.append(match[1])
                single = single or match[1][0] == 1
                match = next(matches, None)
            if not single:
                ways.append((1, self.unknown))
            top, length = -math.inf, 0
            for width, score in sorted(ways, reverse=True):
                total = best[(end + 1 - width) % held] + score
                if total > top:
                    top, length = total, width
            source, place = (end + 1 - length) % held, (end + 1) % held
            unknown = length == 1 and not single
            if not unknown:
                more = 1
            elif self.by_bytes:
                more = len(letter.encode())
            else:
                more = 0 if fused[source] else 1
            best[place], fused[place] = top, unknown
            tokens[place] = tokens[source] + more
            unknowns[place] = unknowns[source] + unknown
        return tokens[len(word) % held], unknowns[len(word) % held]

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = self.count(SPACE + word.decode())
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = found
        return found


_counters: dict[str, Counter] = {}


def counter_of(model: str) -> Counter:
    """This worker's counter of a file of pieces."""
    if model not in _counters:
        _counters[model] = Counter(ranked_pieces(model), falls_back(model))
    return _counters[model]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``tkey``, ``n_words``, ``n_tokens`` and ``n_unknown`` (characters that no piece
    covers) of every whole text; one row per row of ``docs``, in one pass without a shuffle.

    ``model`` is the file whose pieces are used (see :func:`ranked_pieces`); where it has
    byte pieces, an unknown character counts as its bytes. Words are runs without ASCII
    white space, each counted with a space mark before it; text is taken as it is, so the
    name of a control piece in a text is plain text. A null or empty text has 0 of all. Each row
    is counted for itself: repeated rows give repeated results, other columns are not looked
    at, whatever their names, and an empty table gives an empty result. A worker holds the
    automaton, a bounded number of words and one batch of texts.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, tkey bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
    arrow = pa.schema([("doc_id", _arrow(docs, id_col)), *((c, pa.int64()) for c in ("tkey", "n_words", "n_tokens", "n_unknown"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(2).to_pylist():
                own = text.encode().split()
                found = [counter[w] for w in own]
                words.append(len(own))
                tokens.append(sum(f[0] for f in found))
                unknown.append(sum(f[1] for f in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], schema=arrow)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)

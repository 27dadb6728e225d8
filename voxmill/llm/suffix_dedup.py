"""Repeated byte strings by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from voxmill.llm.repeats import Method, Segment, find_repeats, merged
from voxmill.llm.shingle_join import mixed

#: Bytes that the first buckets look at.
GRAM = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 16


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def byte_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = _CHUNK + gram
    up, down = _powers(size)
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(n, np.uint64)
    for start in range(0, n, _CHUNK):
        part = raw[start : start + size - 1].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
        own = (total[gram:] - total[:-gram]) * down[: len(part) - gram + 1]
        out[start : start + len(own)] = own[: n - start]
    return mixed(out)


def refine(data: bytes, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of equal strings of ``size`` bytes: (places, bucket of each place), of
    buckets with two places or more. ``ends`` is, for each place, the end of its segment.

    The first buckets are the different values of ``GRAM`` bytes. A bucket is split by
    the bucket that each place has so many bytes later, which doubles what the buckets
    look at; the pointers to buckets that one round has set are what the next one sorts by.
    A place alone in its bucket is settled, and only serves others as a pointer.
    """
    n = len(data)
    raw = np.frombuffer(data + bytes(GRAM), np.uint8).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(GRAM):
        first |= raw[k : k + n] << np.uint64(8 * k)
    places = np.nonzero(np.arange(n) + size <= ends)[0]
    _, pointer = np.unique(first, return_inverse=True)
    pointer = pointer.astype(np.uint64)
    live, width = np.arange(n), GRAM
    while width < size and len(places):
        step = min(width, size - width)
        live = live[live + width + step <= ends[live]]
        keys = (pointer[live] << np.uint64(32)) | pointer[live + step]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        fresh = np.arange(n, dtype=np.uint64) + np.uint64(n)  # of its own, unless shared
        shared = counts[inverse] > 1
        fresh[live[shared]] = inverse[shared].astype(np.uint64)
        pointer, live, width = fresh, live[shared], width + step
    chosen = live[live + size <= ends[live]]
    return chosen, pointer[chosen].astype(np.int64)


def solve_bytes(segments: list[Segment], size: int) -> list[tuple]:
    """Rows of a shard (see ``repeats``): every string that comes twice goes."""
    bodies: dict[bytes, list[Segment]] = {}
    for s in {s.place: s for s in segments}.values():
        bodies.setdefault(s.body, []).append(s)
    by_anchor: dict[int, list[bytes]] = {}
    for body, own in bodies.items():
        by_anchor.setdefault(own[0].anchor, []).append(body)
    # a body that comes twice goes as a whole; only others are compared, string by string
    rows = [(0, s.doc_id, s.tkey, s.at, s.at + len(body), 0, 0) for body, own in bodies.items() if len(own) > 1 for s in own]
    open_ones = any(own[0].blocks > 1 for own in bodies.values())
    compared = [
        body for own in by_anchor.values() for body in own
        if open_ones or len(own) > 1 and any(len(bodies[b]) == 1 for b in own)
    ]
    if not compared:
        return rows
    lengths = np.asarray([len(body) for body in compared])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    places, buckets = refine(b"".join(compared), np.repeat(starts[1:], lengths), size)
    owner = np.searchsorted(starts, places, "right") - 1
    cut = np.nonzero((np.diff(places) != 1) | (np.diff(owner) != 0))[0] + 1
    if len(places):
        for lo, hi in zip([0, *cut.tolist()], [*(cut - 1).tolist(), len(places) - 1]):
            own = bodies[compared[owner[lo]]]
            if len(own) == 1:
                base = own[0].at - int(starts[owner[lo]])
                rows.append((0, own[0].doc_id, own[0].tkey, base + int(places[lo]), base + int(places[hi]) + size, 0, 0))
    if open_ones:
        bucket_of, told = dict(zip(places.tolist(), buckets.tolist())), set()
        for k, body in enumerate(compared):
            s = bodies[body][0]
            for at in range(len(body) - size + 1 if s.blocks > 1 else 0):
                bucket = bucket_of.get(int(starts[k]) + at)
                if bucket is None or bucket not in told:
                    told.add(bucket)
                    digest = xxh3_128_intdigest(body[at : at + size])
                    rows.append((1, s.doc_id, s.tkey, s.at + at, s.at + at + size, _signed(digest >> 64), _signed(digest)))
            told.discard(None)
    return rows


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _method(size: int) -> Method:
    return Method(
        size=size, gram=max(1, size // 4), units=str.encode, hashes=byte_hashes, body=lambda data, lo, hi: data[lo:hi],
        solve=lambda segments: solve_bytes(segments, size), shard_bytes=1 << 17, first_stays=False,
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans_out, kept_out, digests = [], [], []
        for text, spans in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            data = text.encode()
            gone = merged([(s["lo"], s["hi"]) for s in spans or ()])
            kept, at = [], 0
            for lo, hi in gone:
                kept.append(data[at:lo])
                at = hi
            left = b"".join([*kept, data[at:]])
            spans_out.append([{"lo": lo, "hi": hi} for lo, hi in gone])
            kept_out.append(left if gone else None)
            digests.append(hashlib.sha256(left).hexdigest())
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(spans_out, kind), pa.array(kept_out, pa.binary()), pa.array(digests, pa.string())],
            names=["doc_id", "tkey", "n_bytes", "spans", "kept", "kept_sha256"],
        )


def drop_repeated_bytes(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, n_bytes, spans, kept, kept_sha256) of every row of ``docs``.

    A byte of a text (in UTF-8) goes if a string of ``size`` bytes that covers it also
    starts anywhere else, in the same document or another. ``spans`` are the maximal runs
    that go (``lo`` to before ``hi``), ``kept`` is what is left of a text that loses
    something (null: the text stays whole), ``kept_sha256`` the digest of what is left.

    Strings are found exactly, by :func:`refine`, among the stretches whose anchors come
    again (see ``repeats``); only for anchors with more than a block of segments are
    strings of different blocks compared by 128-bit digests.

    Null and empty texts have no bytes. Texts shorter than ``size`` stay whole. Rows with
    one id and one text are one document, so they are not copies of each other; rows with
    one id and different texts are different documents. Ids are integers or null. Other
    columns are not looked at. An empty table gives an empty result.
    """
    settled, compared = find_repeats(docs, _method(size), F.octet_length("text"), F.sha2("text", 256), id_col, text_col)
    shape = "doc_id bigint, tkey bigint, n_bytes bigint, spans array<struct<lo:bigint,hi:bigint>>, kept binary, kept_sha256 string"
    spans = F.when(F.col("gone"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    easy = settled.select(
        "doc_id", "tkey", F.col("n").alias("n_bytes"), spans.alias("spans"), F.when(F.col("gone"), F.lit(b"")).alias("kept"),
        F.when(F.col("gone"), F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    return easy.union(compared.mapInArrow(_cut, shape))


def removed(spans: str = "spans") -> tuple:
    """(units that go, number of runs) of a column of spans."""
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return total, F.size(spans).cast("long")

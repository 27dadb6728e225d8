"""Passages that come again: the frame that suffix and phrase deduplication share.

A passage is ``size`` units (bytes or words) of one document. Of the shorter grams in it,
the one with the smallest hash is its anchor, so equal passages have equal anchors, at the
same place. Anchors are rare (one for every half passage) and found by a scan; only where
an anchor comes again may a passage come again, so only there are texts looked at.

    scan        anchors of every document
    recurring   anchors of more than one text, or twice in a text (combined before the
                shuffle; a hot anchor weighs no more than another)
    deal        texts with such anchors, one shuffle; copies of whole texts are settled here
    segments    the stretch of each document whose passages have one recurring anchor,
                sent to the shard of that anchor; a hot anchor has several blocks
    solve       exact comparison inside a shard, by the operator's own method
    open        passages of hot anchors that a block saw once, compared by digest
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import with_key
from voxmill.session import stored_once

#: Segments that a block of a hot anchor gets on average.
BLOCK = 4096
_PLACE_BITS = 20
_LOW = np.uint64((1 << _PLACE_BITS) - 1)
FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])
FOUND_SQL = "kind int, doc_id bigint, tkey bigint, lo bigint, hi bigint, f1 bigint, f2 bigint"


@dataclass(frozen=True)
class Segment:
    """Passages of a document that have one anchor: they start at ``at`` and after."""

    doc_id: int | None
    tkey: int
    at: int
    body: bytes
    blocks: int
    anchor: int = 0

    @property
    def place(self) -> tuple:
        """Order of occurrences: null ids first, then id, text, place."""
        return self.doc_id is not None, self.doc_id or 0, self.tkey, self.at


@dataclass(frozen=True)
class Method:
    """What an operator adds to the frame.

    ``units(text)`` gives the units of a text, ``hashes(units, gram)`` a 64-bit hash of
    each gram, ``body(units, lo, hi)`` some of the units as bytes, ``solve(segments)`` the
    rows of a shard: (0, id, key, lo, hi, 0, 0) for units that go, and for passages of
    several blocks (1, id, key, lo, hi, digest, digest) for one that came once in its
    block or stands for those that came more often.
    """

    size: int
    gram: int
    units: Callable
    hashes: Callable
    body: Callable
    solve: Callable
    #: Bytes of segments that a shard compares at once; a block is never cut.
    shard_bytes: int
    #: Whether the first occurrence stays.
    first_stays: bool


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes the place of its smallest, of equal ones the
    leftmost (by their 44 upper bits, so that place and hash fit into one number)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    step = (1 << _PLACE_BITS) - width
    for start in range(0, n, step):
        part = hashes[start : start + step + width - 1]
        low = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        seen = 1
        while 2 * seen <= width:
            low = np.minimum(low[:-seen], low[seen:])
            seen *= 2
        if seen < width:
            low = np.minimum(low[: len(low) - (width - seen)], low[width - seen :])
        out[start : start + len(low)] = (low & _LOW).astype(np.int64) + start
    return out


def _scan(m: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row, at = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                units = m.units(text)
                if len(units) < m.size:
                    continue
                h = m.hashes(units, m.gram)
                places = anchors(h, m.size - m.gram + 1)
                places = places[np.concatenate([[True], places[1:] != places[:-1]])]
                hashes.append(h[places]), at.append(places), row.append(np.full(len(places), k))
            if not hashes:
                continue
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(at).astype(np.int32))],
                names=["h", "doc_id", "tkey", "at"],
            )

    return run


def _segments(m: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for ident, key, text, marked in zip(*(c.to_pylist() for c in batch.columns)):
                units = m.units(text)
                h = m.hashes(units, m.gram)
                place = anchors(h, m.size - m.gram + 1)
                blocks = {x["h"]: x["blocks"] for x in marked}
                edge = np.nonzero(place[1:] != place[:-1])[0] + 1
                firsts, lasts = [0, *edge.tolist()], [*(edge - 1).tolist(), len(place) - 1]
                for first, last, own in zip(firsts, lasts, h[place[firsts]].view(np.int64).tolist()):
                    if own in blocks:
                        n = blocks[own]
                        body = m.body(units, first, last + m.size)
                        out.append((own, (key & 0x7FFFFFFF) % n, n, ident, key, first, body))
                        held += len(body)
                        if held > 1 << 24:
                            yield _batch(out)
                            out, held = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["h", "block", "blocks", "doc_id", "tkey", "at", "body"])


def _shards(m: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, last = [], 0, None

        def solved() -> pa.RecordBatch:
            rows = m.solve(group)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND) if rows else None

        for batch in batches:
            for h, block, blocks, ident, key, at, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, block) != last and held >= m.shard_bytes:
                    if out := solved():
                        yield out
                    group, held = [], 0
                last = (h, block)
                group.append(Segment(ident, key, at, body, blocks, h))
                held += len(body)
        if group and (out := solved()):
            yield out

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Rising spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def find_repeats(docs: DataFrame, m: Method, count: Column, untouched: Column, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, tkey, n, digest, gone) of the documents that are settled without
    a comparison (``gone``: all units go), and (doc_id, tkey, n, text, spans) of the others.

    ``count`` and ``untouched`` are expressions of a text: its number of units, and what is
    to be kept of a text that stays whole.
    """
    rows = with_key(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = rows.select("doc_id", "tkey", "text").mapInArrow(_scan(m), "h bigint, doc_id bigint, tkey bigint, at int")
    counts = found.groupBy(F.col("h").alias("again")).agg(
        F.count("*").alias("n"), F.min("tkey").alias("k0"), F.max("tkey").alias("k1"), F.min("at").alias("a0"), F.max("at").alias("a1")
    )
    counts = counts.filter("k0 <> k1 OR a0 <> a1").select("again", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    marks = found.select("h", "doc_id", "tkey").join(counts, F.col("h") == F.col("again"))
    marks = marks.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("h", "blocks")).alias("marked"))

    # documents of one text: all that holds of the first holds of the others
    texts = rows.select("doc_id", "tkey", F.md5("text").alias("digest")).groupBy("digest").agg(
        F.min(F.struct("doc_id", "tkey")).alias("first"), F.max(F.struct("doc_id", "tkey")).alias("last")
    ).filter("first <> last")
    ids = rows.select("doc_id", "tkey", F.md5("text").alias("md")).distinct().join(texts, F.col("md") == F.col("digest"), "left")
    own = F.struct("doc_id", "tkey")
    ids = ids.select(
        F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), F.col("first").isNotNull().alias("copied"),
        F.coalesce(own == F.col("first"), F.lit(True)).alias("is_first"),
    )
    marks = marks.withColumnRenamed("doc_id", "_mid").withColumnRenamed("tkey", "_mkey")
    ids = ids.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_key") == F.col("_mkey")), "left").select(
        "_id", "_key", "copied", "is_first", F.when(F.col("is_first"), F.col("marked")).alias("marked")
    )
    dealt = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key")))
    n = count.cast("long")
    lost = (F.col("n") >= m.size) & ((F.col("copied") & ~F.col("is_first")) if m.first_stays else F.col("copied"))
    compared = F.col("marked").isNotNull()
    dealt = dealt.withColumn("n", n).withColumn("gone", lost).select(
        "doc_id", "tkey", "n", "gone", "copied", "marked",
        F.when(compared, F.col("text")).alias("text"), F.when(~compared & ~F.col("gone"), untouched).alias("digest"),
    )
    dealt = stored_once(dealt, "dealt")

    marked = dealt.filter("marked IS NOT NULL")
    segments = marked.select("doc_id", "tkey", "text", "marked").mapInArrow(
        _segments(m), "h bigint, block int, blocks int, doc_id bigint, tkey bigint, at bigint, body binary"
    )
    shards = segments.repartition("h", "block").sortWithinPartitions("h", "block")
    solved = stored_once(shards.mapInArrow(_shards(m), FOUND_SQL), "found")
    spans = solved.filter("kind = 0").select("doc_id", "tkey", "lo", "hi").union(_opened(solved.filter("kind = 1"), m.first_stays))
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key"))
    compared = marked.join(spans, same, "left").select("doc_id", "tkey", "n", "text", F.when(F.col("gone"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))).otherwise(F.col("spans")).alias("spans"))
    return dealt.filter("marked IS NULL").select("doc_id", "tkey", "n", "gone", "digest"), compared


def _opened(rows: DataFrame, first_stays: bool) -> DataFrame:
    """Of passages that several blocks of a hot anchor hold, those that go."""
    place = F.struct("doc_id", "tkey", "lo")
    all_of = rows.groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    met = rows.join(all_of.filter("n > 1"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
    return (met.filter(place != F.col("first")) if first_stays else met).select("doc_id", "tkey", "lo", "hi")

"""Embedding near-duplicates by an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import components
from voxmill.session import stored_once

#: Vectors that a block holds on average, and the most pivots (what goes to the driver).
BLOCK, MOST_PIVOTS = 4096, 1024
#: Slack for rounding where the triangle inequality decides what to compare.
SLACK = 1e-6
_PROBES = 1024


def _unit(flat: pa.ListArray) -> np.ndarray:
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _deal(pivots: np.ndarray, blocks: list[int] | None, radius: float):
    """Vectors to their home cell, or (with the number of blocks of each cell) to every
    block where they are at home or have to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(2), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2))
            square = np.maximum(2 - 2 * x @ pivots.T, 0)
            home = square.argmin(1)
            if blocks is None:
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32))], names=["cell"])
                continue
            hashed = batch.column(3).to_numpy()
            row, cell, block, kind = [], [], [], []
            own = square[np.arange(len(x)), home]
            for i in range(len(x)):
                h = int(home[i])
                b = int(hashed[i] % blocks[h])
                row.append(i), cell.append(h), block.append(b), kind.append(0)
                for other in range(b):
                    row.append(i), cell.append(h), block.append(other), kind.append(1)
                # a vector nearer to pivot p lies beyond the plane halfway between p and h
                gap = (square[i, :h] - own[i]) / (2 * np.maximum(between[:h, h], 1e-12))
                for p in np.nonzero(gap <= radius + SLACK)[0].tolist():
                    for other in range(blocks[p]):
                        row.append(i), cell.append(p), block.append(other), kind.append(1)
            for k in range(0, len(row), 8192):
                part = pa.array(row[k : k + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[k : k + 8192], pa.int32()), pa.array(block[k : k + 8192], pa.int32()), pa.array(kind[k : k + 8192], pa.int32())]
                    + [batch.column(c).take(part) for c in (0, 1, 2)],
                    names=["cell", "block", "kind", "cid", "copies", "embedding"],
                )

    return run


class _Block:
    """The vectors at home in one block, their links and what hangs together through them."""

    def __init__(self, least: float) -> None:
        self.least, self.ids, self.copies, self.parts = least, [], [], []
        self.rows: np.ndarray | None = None
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def home(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        self.ids.append(ids), self.copies.append(copies), self.parts.append(x)

    def _close(self) -> None:
        self.id = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        self.weight = np.concatenate(self.copies).astype(np.float64) if self.copies else np.zeros(0)
        self.rows = np.concatenate(self.parts) if self.parts else np.zeros((0, 1))
        self.links = np.zeros(len(self.id))
        self.label = np.arange(len(self.id))
        for k in range(0, len(self.id), _PROBES):
            part = slice(k, k + _PROBES)
            self._meet(self.rows[part], self.weight[part], None, k)

    def probe(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        if self.rows is None:
            self._close()
        if len(self.id):
            for k in range(0, len(ids), _PROBES):
                part = slice(k, k + _PROBES)
                self._meet(x[part], copies[part].astype(np.float64), ids[part], 0)

    def _meet(self, x: np.ndarray, weight: np.ndarray, ids: np.ndarray | None, first: int) -> None:
        near = self.rows @ x.T >= self.least
        if ids is None:
            near[first + np.arange(len(x)), np.arange(len(x))] = False
        linked = np.nonzero(near.any(0))[0]
        if not len(linked):
            return
        near = near[:, linked]
        self.links += near @ weight[linked]
        none = len(self.label)
        while True:  # homes that meet a common vector hang together
            seen = np.where(near, self.label[:, None], none).min(0)
            if ids is None:
                seen = np.minimum(seen, self.label[first + linked])
            lower = np.minimum(self.label, np.where(near, seen[None], none).min(1))
            if ids is None:
                lower[first + linked] = np.minimum(lower[first + linked], seen)
            if (lower == self.label).all():
                break
            changed = np.arange(none)
            np.minimum.at(changed, self.label, lower)
            for _ in range(64):
                jumped = changed[changed]
                if (jumped == changed).all():
                    break
                changed = jumped
            self.label = changed[self.label]
        if ids is not None:
            self.out.append((ids[linked], self.weight @ near, self.id[seen]))

    def result(self) -> pa.RecordBatch:
        if self.rows is None:
            self._close()
        own = np.nonzero(self.links > 0)[0]
        self.out.append((self.id[own], self.links[own], self.id[self.label[own]]))
        ids, links, near = (np.concatenate(c) for c in zip(*self.out))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links.astype(np.int64)), pa.array(near, pa.int64())], names=["id", "links", "near"])


def _join(least: float):
    """Blocks, one after the other, as they come sorted by cell, block and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, kind, ids, copies = (batch.column(c).to_numpy() for c in range(5))
            x = _unit(batch.column(5))
            edge = np.nonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0))[0] + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)]):
                now = (cell[lo], number[lo])
                if now != key:
                    if block is not None:
                        yield block.result()
                    key, block = now, _Block(least)
                (block.probe if kind[lo] else block.home)(ids[lo:hi], copies[lo:hi], x[lo:hi])
        if block is not None:
            yield block.result()

    return run


def link_embeddings(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """id, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Two vectors are linked if their cosine, in double precision, is ``least`` or more. Unit
    vectors that are so near lie within sqrt(2 - 2 least) of each other, so the join is a
    range join in a metric space. Pivots are a hashed sample of at most ``MOST_PIVOTS``
    vectors, about one for every ``block`` vectors; a vector is at home with the nearest
    one. By the triangle inequality two near vectors of different cells lie near the plane
    between the cells, so a vector is also sent to the cells (of smaller number) whose
    plane it is near to, and every pair meets in one place. Cells are cut into blocks by
    a hash of the id; a task holds one block and streams what is to be compared with it,
    so a cell may be as large as it likes. Nothing but counts and a spanning forest leaves
    a block.

    Equal vectors are one row of the join with a count. Vectors that are null, zero or hold
    null or non-finite components link with nothing, nor do those of another length than
    most pivots have, each length being a table of its own. A row with a null id has no
    component, no links and is not kept. Vectors that share an id are one node. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b * b)
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & (size > 0) & (size < math.inf) & ~F.isnan(size)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.filter("sound").groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    classes = stored_once(classes, "vectors")
    lengths = [r[0] for r in classes.groupBy(F.size("embedding").alias("n")).count().orderBy("n").select("n").collect()]
    found = None
    for n in lengths:
        part = _links_of_length(classes.filter(F.size("embedding") == n), least, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored_once(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("near").alias("b"))).withColumnRenamed("id", "node")
    known = classes.select(F.col("embedding").alias("_e"), "cid", "copies")
    out = rows.join(known, F.col("sound") & (F.col("embedding") == F.col("_e")), "left").drop("_e", "embedding")
    out = out.join(links, F.col("cid") == F.col("id"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    out = out.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "cid", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of_length(classes: DataFrame, least: float, block: int) -> DataFrame:
    n = classes.count()
    wanted = max(1, min(MOST_PIVOTS, math.ceil(n / block)))
    chosen = classes.orderBy(F.xxhash64("cid"), "cid").limit(wanted).select("embedding").collect()
    pivots = np.asarray([r[0] for r in chosen], np.float64)
    pivots /= np.sqrt((pivots * pivots).sum(1))[:, None]
    rows = classes.select("cid", "copies", "embedding", F.abs(F.xxhash64("cid") % (1 << 30)).alias("hashed"))
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    counts = dict(rows.mapInArrow(_deal(pivots, None, radius), "cell int").groupBy("cell").count().collect())
    blocks = [max(1, math.ceil(counts.get(p, 0) / block)) for p in range(len(pivots))]
    dealt = rows.mapInArrow(_deal(pivots, blocks, radius), "cell int, block int, kind int, cid bigint, copies bigint, embedding array<double>")
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "cid")
    return dealt.mapInArrow(_join(least), "id bigint, links bigint, near bigint")

"""Trie of shared conversation prefixes, built block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.numbering import running_sums
from voxmill.session import stored_once

#: Turns in a block.
BLOCK = 4
#: Digests are pairs of numbers of so many bits that add up without overflow.
BITS = 55
#: Ids that are joined in one piece before they are hashed.
CHUNK = 1 << 14

_MASK = (1 << BITS) - 1
#: What a node is known by: the digests of its turns.
_ID = ["id1", "id2"]


def ordered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, place, n_turns, k1, k2, n_bytes): every turn's place from 0 and two hashes of it.

    Turns are ordered by ``turn_col``, null first, equal ones by the hashes; null role or
    text is empty; rows without a conversation are left out. Texts are read once, here.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), text, role).alias("k2"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    placed = running_sums(rows, ["turn", "k1", "k2"], {"place": F.lit(1)}, ["conv_id"])
    return placed.select("conv_id", "place", F.col("place_total").alias("n_turns"), "k1", "k2", "n_bytes")


def spliced(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``turns`` where a conversation's first turns are those of the first one of its group
    of ids: a checksum of the id says how many (below ``most``). (conv_id, place, k1, k2, n_bytes)."""
    convs = turns.filter("place = 0").select("conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    convs = convs.join(lengths, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken"))
    heads = turns.filter((F.col("place") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "place", "k1", "k2", "n_bytes")
    borrowed = convs.join(heads, "base").filter("place < h").select("conv_id", "place", "k1", "k2", "n_bytes")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place >= h")
    return borrowed.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "k1", "k2", "n_bytes"))


def _digests(number: Column, steps: Column) -> list[Column]:
    """Two hashes of the first turns of block ``number``. Sums of them over blocks tell
    prefixes apart, and a sum can be taken in any order."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(seed), number, F.transform(steps, lambda s: F.struct(s["k1"], s["k2"]))), 64 - BITS) for seed in (3, 5)]


def _added(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(_MASK))


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, number, steps, last, p1, p2): conversations cut into blocks, each with the
    digest of all blocks before it."""
    number = F.expr(f"place DIV {BLOCK}").alias("number")
    step = F.struct("place", "k1", "k2", "n_bytes")
    blocks = turns.groupBy("conv_id", number).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    blocks = blocks.select("conv_id", "number", F.transform("steps", lambda s: F.struct(s["k1"].alias("k1"), s["k2"].alias("k2"), s["n_bytes"].alias("n_bytes"))).alias("steps"))
    d1, d2 = _digests(F.col("number"), F.col("steps"))
    # Decimals, since a sum over very many blocks would not fit into 64 bits.
    weights = {"p1": d1.cast("decimal(20,0)"), "p2": d2.cast("decimal(20,0)"), "before": F.lit(1)}
    summed = running_sums(blocks, ["number"], weights, ["conv_id"])
    ids = [(F.col(p) % F.lit(1 << BITS)).cast("bigint").alias(p) for p in ("p1", "p2")]
    return summed.select("conv_id", "number", "steps", (F.col("before") + 1 == F.col("before_total")).alias("last"), *ids)


def _cut_open(blocks: DataFrame, *kept: str) -> DataFrame:
    """A row per turn of each block: the node it leads to and that node's parent."""
    at = F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("j")
    rows = blocks.select("number", "steps", "p1", "p2", at, *kept)

    def node(j: Column) -> list[Column]:
        some = _digests(F.col("number"), F.slice("steps", 1, j))
        return [F.when(j == 0, F.col(p)).otherwise(_added(F.col(p), d)) for p, d in zip(("p1", "p2"), some)]

    ids = [c.alias(n) for c, n in zip([*node(F.col("j")), *node(F.col("j") - 1)], (*_ID, "up1", "up2"))]
    return rows.select(*ids, (F.col("number") * BLOCK + F.col("j")).alias("depth"), F.element_at("steps", F.col("j"))["n_bytes"].alias("n_bytes"), *kept)


def _nodes(blocks: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """All nodes: (id1, id2, up1, up2, depth, n_bytes, n_convs, conv_id).

    Conversations are grouped by whole blocks first, so equal ones are one row from here.
    Where a prefix goes on with one block only, its turns are nodes as they stand; only
    where siblings diverge are blocks taken apart and grouped turn by turn."""
    folded = blocks.groupBy("number", "p1", "p2", "steps").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    folded = stored_once(folded.select("*", *(d.alias(n) for d, n in zip(_digests(F.col("number"), F.col("steps")), ("d1", "d2")))), "folded")
    key = ["number", "p1", "p2"]
    only = folded.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.min("d1").alias("d1"), F.min("d2").alias("d2")).filter("m = 1").drop("m")
    # The digests of the block itself are part of the key, so a hot parent is no hot key.
    alone = _cut_open(folded.join(only, [*key, "d1", "d2"], "left_semi"), "n_convs", "conv_id")
    split = _cut_open(folded.join(only, [*key, "d1", "d2"], "left_anti"), "n_convs", "conv_id")
    merged = split.groupBy(*_ID, "depth").agg(
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.max("n_bytes").alias("n_bytes"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    root = conv_ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = root.select(zero.alias("id1"), zero.alias("id2"), none.alias("up1"), none.alias("up2"), zero.alias("depth"), zero.alias("n_bytes"), "n_convs", "conv_id")
    return root.unionByName(alone).unionByName(merged)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches, full at so many rows or so many characters of their last column."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= 4096 or size >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id1, id2, conv_id) to (id1, id2, first, part): ids side by side, joined."""

    def parts() -> Iterator[tuple]:
        for one, rows in groupby(_rows(batches), lambda r: r[:2]):
            while held := [r[2] for r in islice(rows, CHUNK)]:
                yield (*one, held[0], ",".join(map(str, held)))

    return _batches(parts(), pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("first", pa.int64()), ("part", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (id1, id2, ends_sha256); a node's chunks are hashed as they come."""

    def digests() -> Iterator[tuple]:
        for one, rows in groupby(_rows(batches), lambda r: r[:2]):
            digest = hashlib.sha256(next(rows)[3].encode())
            for row in rows:
                digest.update(b"," + row[3].encode())
            yield (*one, digest.hexdigest())

    return _batches(digests(), pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("ends_sha256", pa.string())]))


def _ends(ends: DataFrame) -> DataFrame:
    """(id1, id2, ends_sha256): the digest of the rising ids of the conversations that end
    at a node. Ids are sorted and joined over ranges of even size, so even a node at which
    very many end is spread; one task then hashes its joined pieces one after the other."""
    parts = ends.select(*_ID, "conv_id").repartitionByRange(*_ID, "conv_id").sortWithinPartitions(*_ID, "conv_id")
    parts = parts.mapInArrow(_chunks, "id1 bigint, id2 bigint, first bigint, part string")
    return parts.repartition(*_ID).sortWithinPartitions(*_ID, "first").mapInArrow(_hashed, "id1 bigint, id2 bigint, ends_sha256 string")


def _summed_paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, up, at, leaves, saved): for every path, i.e. all nodes with one smallest
    member, what it and all paths that hang on it hold; it hangs on the node (up, at).

    Pointers double: after step i a path holds the sums of what is less than 2^i paths
    below it, and adds its sums to the path 2^i above."""
    top = F.min(F.struct("depth", "parent_conv_id")).alias("top")
    paths = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"), top)
    paths = paths.select("conv_id", F.col("top.parent_conv_id").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved")
    paths = stored_once(paths.withColumn("far", F.col("up")), "paths")
    while not paths.filter("far IS NOT NULL").isEmpty():
        below = paths.filter("far IS NOT NULL").groupBy(F.col("far").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = paths.filter("far IS NOT NULL").select(F.col("conv_id").alias("far"), F.col("far").alias("further"))
        paths = paths.join(below, "conv_id", "left").join(further, "far", "left").select(
            "conv_id", "up", "at", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("further").alias("far"),
        )
        paths = stored_once(paths, "paths")
    return paths.drop("far")


def prefix_trie(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """A row per node of the trie of all prefixes of ``turns`` (conv_id, place from 0, k1,
    k2, n_bytes; see :func:`ordered_turns`).

    A node is a distinct sequence of first turns; its members are the conversations that
    start with it. ``conv_ids`` has the column ``conv_id`` with all conversations, so that
    those without turns are members of the root. Columns: ``conv_id`` (smallest member;
    with ``depth`` it names the node, and its first ``depth`` turns are the node's),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes in its subtree), ``saved_tokens`` (bytes that members share
    with an earlier one, over its subtree) and ``ends_sha256`` (digest of the ids of the
    conversations that end there, rising, joined by commas).

    Without conversations there are no rows. Turns are compared by 128-bit and prefixes by
    110-bit hashes. A conversation or a prefix may hold any share of all rows: conversations
    are cut into blocks, equal ones are folded, and what adds up along a path does so over
    ranges of even size.
    """
    blocks = stored_once(_blocks(turns), "blocks")
    nodes = stored_once(_nodes(blocks, conv_ids), "trie")
    children = nodes.filter("depth > 0").groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    steps = _digests(F.col("number"), F.col("steps"))
    ends = blocks.filter("last").select(*(_added(F.col(p), d).alias(n) for p, d, n in zip(("p1", "p2"), steps, _ID)), "conv_id")
    zero = F.lit(0).cast("bigint")
    turnless = conv_ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    ends = ends.unionByName(turnless.select(zero.alias("id1"), zero.alias("id2"), "conv_id"))
    nodes = nodes.join(children, _ID, "left").join(parents, ["up1", "up2"], "left").join(_ends(ends), _ID, "left")
    none = hashlib.sha256().hexdigest()
    nodes = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    nodes = stored_once(nodes, "nodes")
    hanging = _summed_paths(nodes).filter("up IS NOT NULL")
    hanging = hanging.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    whole = nodes.join(hanging, ["conv_id", "depth"], "left")
    whole = running_sums(whole, ["depth"], {"l": F.col("leaf") + F.coalesce("more_leaves", zero), "s": F.col("own") + F.coalesce("more_saved", zero)}, ["conv_id"])
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l_total") - F.col("l")).alias("n_leaves"),
        (F.col("s_total") - F.col("s")).alias("saved_tokens"), "ends_sha256",
    )

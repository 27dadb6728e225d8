"""N-gram Jaccard join with PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from voxmill.llm.common import components, with_key
from voxmill.session import drop_stored, stored_once

#: From this distance on, parts may be so small that some are empty: then a set has spare
#: first-level partitions.
FAR = 16
#: Features that a signature should cover at least.
COVER_NEAR = 6.0
#: Bits of the sketch of a set that candidates are first compared by; a set of more features
#: has a second one with a bit for each of them or more.
SKETCH = 512
#: So many of a member's signatures tell in which bucket a pair is to be compared.
TOLD = 8
_ROWS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Rising 64-bit hashes of the different shingles of a text: A-Z in lower case, words
    by ASCII white space; fewer words than ``width`` are one shingle, none are no shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = mixed(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for k in range(min(width, len(words))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def same_share(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sets is num / den or more."""
    if len(a) * den < len(b) * num or len(b) * den < len(a) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


@cache
def bands(num: int, den: int, most: int) -> list[int]:
    """Upper ends of size bands such that linked sets lie in one band or in neighbours."""
    ends = [1]
    while ends[-1] < most:
        ends.append(-(-ends[-1] * den // num) if ends[-1] * den // num > ends[-1] else ends[-1] + 1)
    return ends


@cache
def scheme(distance: int, least: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of ``least`` features or more that differ in at most
    ``distance``: n1 partitions of n2 parts each; in at least spare + 1 partitions at most
    k2 parts differ, so some n2 - k2 parts agree there. Of the schemes whose signatures
    cover enough features, that with the fewest signatures."""
    if distance >= FAR:  # two parts of which one may differ, and as many spare ones as are empty
        short = {}  # by how much the spare partitions may be too few
        for spare in range(3, 4 + distance // 4):
            n1 = distance // 2 + 1 + spare
            empty = 2 * n1 * exp(-least / (2 * n1))
            short[spare] = max(0, int(empty + 4 * sqrt(empty)) + 3 - spare)
            if not short[spare]:
                break
        spare = min(short, key=lambda k: (short[k], k))
        return distance // 2 + 1 + spare, 2, 1, spare
    options = []
    for k2 in range(0, 4):
        n1 = distance // (k2 + 1) + 1
        for n2 in range(k2 + 1, k2 + 5):
            covered = least * (n2 - k2) / (n1 * n2)
            signatures = n1 * comb(n2, k2)
            if signatures <= 4 * (distance + 1):
                options.append((max(0.0, COVER_NEAR - covered), signatures, n1, n2, k2))
    _, _, n1, n2, k2 = min(options)
    return n1, n2, k2, 0


@cache
def _choices(n1: int, n2: int, k2: int) -> np.ndarray:
    own = np.asarray(list(combinations(range(n2), n2 - k2)))
    return own[None] + n2 * np.arange(n1)[:, None, None]


def signatures(features: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of a set (its rising feature hashes).

    Sets whose similarity is num / den or more differ in at most (a + b)(den - num) /
    (den + num) features. For its own band and the one above, a set's feature domain is
    cut into n1 partitions of n2 parts (by ranges of the hash), and the content of every
    choice of n2 - k2 parts of a partition is one signature. Two similar sets agree in a
    choice of spare + 1 partitions or more. Choices without a feature say little and are
    mostly left out: if all that two sets agree in is empty, they agree in spare + 1 empty
    ones or more, so they share one of the first that each has but for its last ``spare``.
    With as many spare partitions as parts are likely to be empty, few sets have any to
    tell, and nothing is lost.
    """
    size = len(features)
    ends = bands(num, den, max(size, 1) * 4)
    own = int(np.searchsorted(ends, size))
    content = np.concatenate([[np.uint64(0)], np.cumsum(mixed(features), dtype=np.uint64)])
    out = []
    for band in (own, own + 1):
        least = ends[band - 2] + 1 if band > 1 else 1
        n1, n2, k2, spare = scheme(2 * ends[band] * (den - num) // (den + num), least)
        parts = n1 * n2
        place = ((features >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edge = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64))
        sums, held = np.diff(content[edge]), np.diff(edge)
        choices = _choices(n1, n2, k2)
        n_choices = choices.shape[1]
        label = mixed(np.arange(n1 * n_choices, dtype=np.uint64) + np.uint64(band << 32))
        signs = mixed(sums[choices].sum(2, dtype=np.uint64).ravel() + label)
        empty = held[choices].sum(2).ravel() == 0
        if spare and empty.any():
            out.append(signs[~empty])
            lone = signs[empty]
            if len(lone) > spare:
                out.append(lone[: len(lone) - spare])
        else:
            out.append(signs)
    return np.concatenate(out)


def sketch(features: np.ndarray) -> np.ndarray:
    """How often features fall on each of ``SKETCH`` bits, odd or even: sketches of two sets
    differ in no more bits than the sets do in features. Behind them a digest of the whole
    set, by which copies are known. Behind that, for sets with more features than bits, whose
    short sketches all differ alike, the same over a power of two of bits that is as many or more."""

    def odd(bits: int) -> np.ndarray:
        counts = np.bincount((features & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)

    digest = mixed(features ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)
    fine = [odd(1 << (len(features) - 1).bit_length())] if len(features) > SKETCH else []
    return np.concatenate([odd(SKETCH), [digest], *fine])


def _signer(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(signs: list, at: list, sizes: list, sketches: list) -> pa.RecordBatch:
            counts = [len(s) for s in signs]
            row = np.repeat(np.arange(len(counts)), counts)
            sizes = np.concatenate(sizes)
            keys = np.where(sizes >= 0, np.asarray(at[1], np.int64)[row], 0)  # once per text is enough
            own = pa.array([x.tolist() for x in sketches], pa.list_(pa.int64()))
            own = own.take(pa.array(np.where(sizes >= 0, row, 0), mask=sizes < 0))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(signs).view(np.int64)), pa.array(at[0], pa.int64()).take(pa.array(row)), pa.array(keys), pa.array(sizes), own],
                names=["sign", "doc_id", "tkey", "n", "sketch"],
            )

        for batch in batches:
            signs, at, sizes, sketches, held = [], ([], []), [], [], 0
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(text, width)
                # one row tells the size; it has a bucket of its own
                found = np.asarray([(doc or 0) * 0x9E3779B97F4A7C15 + key & 0xFFFFFFFFFFFFFFFF], np.uint64)
                if len(own) and doc is not None:
                    found = np.concatenate([found, np.unique(signatures(own, num, den))])
                size = np.full(len(found), -1, np.int32)
                size[0] = len(own)
                signs.append(found), at[0].append(doc), at[1].append(key), sizes.append(size), sketches.append(sketch(own))
                held += len(found)
                if held >= _ROWS:
                    yield batch_of(signs, at, sizes, sketches)
                    signs, at, sizes, sketches, held = [], ([], []), [], [], 0
            if signs:
                yield batch_of(signs, at, sizes, sketches)

    return run


def _verifier(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, near = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if tb[i] != last:
                    last, near = tb[i], shingles(tb[i], width)
                if same_share(shingles(ta[i], width), near, num, den):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _plausible(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches do not forbid a link."""
    one = sizes.select(F.col("doc_id").alias("a"), F.struct("n", "sketch").alias("x"))
    two = sizes.select(F.col("doc_id").alias("b"), F.struct("n", "sketch").alias("y"))
    near = pairs.join(one, "a").join(two, "b").filter(_may_link(F.col("x"), F.col("y"), num, den))
    return stored_once(near.select("a", "b").distinct(), "pairs")


def _may_link(x: Column, y: Column, num: int, den: int) -> Column:
    def few(apart: Column) -> Column:
        return apart * (den + num) <= (x["n"] + y["n"]) * (den - num)

    apart = sum((F.bit_count(F.get(x["sketch"], F.lit(k)).bitwiseXOR(F.get(y["sketch"], F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    return (x["n"] * den >= y["n"] * num) & (y["n"] * den >= x["n"] * num) & few(apart) & few(_apart_finely(x["sketch"], y["sketch"]))


def _apart_finely(x: Column, y: Column) -> Column:
    """In how many bits the long sketches of two sets differ; 0 if one of them has none. The
    longer one is folded to the length of the other: the parity of two bits is that of their sum."""
    head = SKETCH // 64 + 1
    words = F.least(F.size(x), F.size(y)) - head

    def folded(own: Column) -> Column:
        first = F.slice(own, head + 1, words)
        more = F.sequence(head + 1 + words, F.size(own), words)
        both = F.aggregate(more, first, lambda sums, at: F.zip_with(sums, F.slice(own, at, words), lambda p, q: p.bitwiseXOR(q)))
        return F.when(F.size(own) == head + words, first).otherwise(both)

    apart = F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when(words > 0, F.aggregate(apart, F.lit(0), lambda total, bits: total + bits)).otherwise(0)


def _linked(pairs: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> list[DataFrame]:
    """The pairs (a, b) that are similar, by their whole texts; stored tables.

    Only texts of which there is a pair are moved. Each pair takes the text of its ``a``
    along to that of its ``b``; where these would outweigh the texts, pairs are checked in
    turns, by ``b``, so that disk follows the texts and not the pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.select(F.col("doc_id").alias("id"), "text", F.octet_length("text").cast("long").alias("bytes")).join(ids, "id", "left_semi")
    texts = stored_once(texts, "texts")
    held = texts.agg(F.sum("bytes")).first()[0] or 0
    moved = pairs.join(texts.select(F.col("id").alias("a"), "bytes"), "a").agg(F.sum("bytes")).first()[0] or 0
    turns, links = -(-moved // max(held, 1)) or 1, []
    for turn in range(turns):
        here = [F.pmod(F.xxhash64(c), F.lit(turns)) == turn for c in ("b", "id")]
        one = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta"))
        two = texts.filter(here[1]).select(F.col("id").alias("ib"), F.col("text").alias("tb"))
        met = pairs.filter(here[0]).join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib")).select("a", "b", "ta", "tb")
        links.append(stored_once(met.mapInArrow(_verifier(width, num, den), "a bigint, b bigint"), "links"))
    drop_stored(texts)
    return links


def join_shingles(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id) of every row of ``docs``.

    Two documents are linked if den * |common shingles| >= num * |all shingles|;
    ``component_id`` is the smallest id that links reach. Shingles are compared by 64-bit
    hashes, and every link is found: signatures lose none, candidates are checked on whole
    texts.

    Buckets of equal signatures are not spread into pairs. Of rows with one and the same set
    (by size, sketch and digest) only the smallest id stays in the buckets, and the others
    are linked to it. First every member is checked
    against the bucket's smallest id, then against one picked at random; then only members
    of different components of a bucket meet, each two in one of their common buckets. So a
    group of near copies costs a few checks per member, not its square. Sizes and sketches of
    the sets, with as many bits as features, tell most pairs apart before any text is looked at.

    Null, empty and blank texts have no shingle and link with nothing. Rows with one id are one node: what any of
    their texts links to. A row with a null id links with nothing and has no component.
    Ids are integers. Other columns are not looked at.
    """
    rows = with_key(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = rows.select("doc_id", "tkey", "text").mapInArrow(_signer(width, num, den), "sign bigint, doc_id bigint, tkey bigint, n int, sketch array<bigint>")
    bucket = Window.partitionBy("sign")
    members = signed.withColumn("low", F.min("doc_id").over(bucket)).withColumn("high", F.max("doc_id").over(bucket))
    buckets = stored_once(members.filter("n >= 0 OR low < high").select("sign", "doc_id", "tkey", "n", "sketch", "low"), "buckets")
    sizes = stored_once(buckets.filter("n >= 0").select("doc_id", "tkey", "n", "sketch"), "sizes")
    copies = stored_once(_copies(sizes), "copies")
    away = stored_once(copies.filter("id > first").select("id").subtract(copies.filter("id = first").select("id")), "away")
    members = buckets.filter("n < 0").select("sign", F.col("doc_id").alias("id"), "low")
    ids = members.select(F.col("id").alias("doc_id")).distinct().join(away.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
    own = stored_once(sizes.join(ids, "doc_id", "left_semi").select("doc_id", "n", "sketch"), "sketches")
    pairs = members.filter("id > low").select("id", "low").distinct().join(away, "id", "left_anti")
    pairs = _plausible(pairs.select(F.col("id").alias("a"), F.col("low").alias("b")), own, num, den)
    found = [copies.filter("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")), *_linked(pairs, rows, width, num, den)]
    drop_stored(pairs)
    roots = stored_once(components(reduce(DataFrame.union, found)), "roots")
    met = buckets
    for last in (False, True):  # what is open after a round was so before it
        before, met = met, stored_once(_open(members, roots, away), "open")
        members = met.select("sign", "id")
        pairs = stored_once(_across(met, own, num, den), "pairs") if last else _plausible(_to_picked(met).distinct(), own, num, den)
        drop_stored(before, roots)
        found.extend(_linked(pairs, rows, width, num, den))
        drop_stored(pairs)
        roots = stored_once(components(reduce(DataFrame.union, found)), "roots")
    drop_stored(copies, away, met, own, *found[1:])
    out = sizes.join(roots, F.col("doc_id") == F.col("id"), "left")
    found = out.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found


def _copies(sizes: DataFrame) -> DataFrame:
    """(id, first): every id that has a shingle, with the smallest id of the same set."""
    held = sizes.filter("n > 0").dropna(subset=["doc_id"])
    first = held.groupBy("n", "sketch").agg(F.min("doc_id").alias("first"))
    return held.join(first, ["n", "sketch"]).select(F.col("doc_id").alias("id"), "first").distinct()


def _open(members: DataFrame, roots: DataFrame, away: DataFrame) -> DataFrame:
    """Members with their components, but for those in ``away``, of buckets that hold more
    than one component."""
    placed = members.join(away, "id", "left_anti").join(roots.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    placed = placed.select("sign", "id", F.coalesce("component_id", "id").alias("root"))
    mixed_ones = placed.groupBy("sign").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("sign")
    return placed.join(mixed_ones, "sign", "left_semi")


def _to_picked(members: DataFrame) -> DataFrame:
    """Each member of a bucket with one picked by a hash, if of another component."""
    picked = members.groupBy("sign").agg(F.min(F.struct(F.xxhash64("id", "sign"), "id", "root")).alias("p"))
    met = members.join(picked, "sign").filter("root <> p.root")
    return met.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b"))


def _across(members: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members of a bucket that lie in different components and may be similar.
    One of two such members is outside the bucket's largest component, so a large component
    is never compared with itself. Near copies share most of their buckets and are paired in
    one: of the ``TOLD`` smallest signatures of each, the smallest that both have; where
    there is none, in every bucket that they share."""
    told = members.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sign")), 1, TOLD).alias("told"))
    facts = sizes.withColumnRenamed("doc_id", "id").join(told, "id").select("id", F.struct("n", "sketch", "told").alias("x"))
    counts = members.groupBy("sign", "root").count()
    largest = counts.groupBy("sign").agg(F.max(F.struct("count", "root")).alias("top")).select("sign", F.col("top.root").alias("top"))
    known = members.join(facts, "id").select("sign", "id", "root", "x")
    far = members.join(largest, "sign").filter("root <> top").join(facts, "id")
    far = far.select(F.col("sign").alias("far_sign"), F.col("id").alias("far"), F.col("root").alias("far_root"), F.col("x").alias("y"))
    here = F.coalesce(F.array_min(F.array_intersect("x.told", "y.told")), F.col("sign")) == F.col("sign")
    may = _may_link(F.col("x"), F.col("y"), num, den) & here
    met = known.join(far, (F.col("sign") == F.col("far_sign")) & (F.col("root") != F.col("far_root")) & may)
    return met.select(F.greatest("id", "far").alias("a"), F.least("id", "far").alias("b")).distinct()

"""The prefix trie against a plain statement."""

import hashlib
import random
import zlib
from collections import defaultdict

from voxmill.llm import prefix_trie, queries

rng = random.Random(9)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    if not convs:
        return set()
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    rows = set()
    for node, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        up = min(members[node[:-1]]) if node else None
        rows.add((min(own), len(node), up, len(own), len(children.get(node, ())), leaves[node], saved[node], digest))
    return rows


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items() if c is not None}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def table(spark, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, place int"
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], schema)


def trie(conversations, splice=False):
    turns = prefix_trie.ordered_turns(conversations)
    found = prefix_trie.prefix_trie(prefix_trie.spliced(turns) if splice else turns, turns.filter("place = 0").select("conv_id"))
    assert found.columns == COLUMNS
    rows = [tuple(r) for r in found.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def some(n, longest):
    rows = []
    for c in rng.sample(range(3 * n), n):
        length, base = rng.randint(1, longest), rng.randrange(3)
        for t in range(length):
            text = f"base {base} é {t}" if rng.random() < 0.9 else rng.choice(["other", "", None])
            rows.append((c, t, rng.choice(["user", "user", None]) if t == 3 else "user", text))
    return rows


def test_equals_plain_statement(spark):
    rows = some(60, 14) + [(1000, t, "user", f"base 0 é {t}") for t in range(40)] + [(1001, t, "user", f"base 0 é {t}") for t in range(40)]
    rows += [(2000, None, "a", "x"), (2000, 3, None, None), (2000, 1, "b", ""), (None, 1, "a", "lost"), (3000, 0, "long", "w " * 50_000)]
    rng.shuffle(rows)
    assert trie(table(spark, rows)) == plain(ordered(rows))
    assert trie(table(spark, rows), splice=True) == plain(rebuilt(ordered(rows)))


def test_chain_of_paths(spark):
    """Each conversation shares one turn more with the next: as deep as paths can hang."""
    rows = []
    for c in range(18):
        rows += [(c, t, "u", f"{'main' if t < c else 'own'} {t if t < c else c}") for t in range(c + 1)]
    found = trie(table(spark, rows))
    assert found == plain(ordered(rows)) and max(r[1] for r in found) == 18


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "u", f"same {t}") for c in range(-20, 120) for t in range(6)]
    rows += [(500, 1, "u", "tie"), (500, 1, "u", "tie"), (501, 1, "u", "tie")]
    assert trie(table(spark, rows)) == plain(ordered(rows))


def test_empty(spark):
    assert trie(table(spark, [])) == set()
    assert trie(table(spark, [(None, 1, "a", "b")]), splice=True) == set()
    assert trie(table(spark, [(7, 0, None, None)]), splice=True) == plain(rebuilt({7: [("", "")]}))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_prefix_trie(spark, sf)
    assert found.columns == COLUMNS
    assert {tuple(r) for r in found.collect()} == plain(rebuilt(ordered(rows)))

"""Spelling groups against a plain statement."""

import random
import re
import zlib
from collections import Counter

import pytest

from voxmill.llm import queries, spelling

rng = random.Random(5)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, drop_every=31):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, {}
    for w in n:
        around = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(around)

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, word string, n int, key int")


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def variant(word):
    k, letter = rng.randrange(len(word) + 1), rng.choice("abcé×")
    return rng.choice([word[:k] + letter + word[k:], word[:k] + word[k + 1 :], word[:k] + letter + word[k + 1 :]])


def test_equals_plain_statement(spark):
    base = ["".join(rng.choices("abcdeé", k=rng.randint(6, 14))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    rows, heavy = [], Counter()
    for w in base:
        heavy[w] += rng.choice([2, 3, 30, 400])
        for _ in range(6):
            v = variant(w)
            heavy[v] += rng.choice([1, 2, 3, 40])
            heavy[variant(v)] += 2
    pool = [w for w, k in heavy.items() for _ in range(k)]
    rng.shuffle(pool)
    rows = [(k, " ".join(w.upper() if rng.random() < 0.1 else w for w in pool[k::40])) for k in range(40)]
    rows += [(7, rows[7][1]), (None, "Aaaaaaa aaaaaaa"), (50, None), (51, ""), (52, " 1 2 ,"), (53, "q" * 4000 + " " + "q" * 4001), (54, "q" * 4000 + " " + "q" * 4001)]
    found = result(spelling.group_spellings(table(spark, rows), drop_every=31))
    want = plain(rows)
    assert found == want
    assert any(f and r != f for f, r, *_ in want.values()), "a chain of forms is wanted"
    assert result(spelling.group_spellings(table(spark, rows))) == plain(rows, None)


def test_empty(spark):
    assert result(spelling.group_spellings(table(spark, []))) == {}
    assert result(spelling.group_spellings(table(spark, [(1, None), (2, "short words here")]))) == {}


def test_signatures_lose_no_pair():
    for _ in range(3000):
        a = "".join(rng.choices("abcdefgé", k=rng.randint(7, 15)))
        b = variant(a)
        if len(b) < 7 or a == b:
            continue
        keys, kinds = spelling.signatures(sorted((a, b), key=len))
        wanted = {(0, 0)} if len(a) == len(b) else {(1, 2)}
        assert any(x == y and (kx, ky) in wanted for x, kx in zip(keys[0], kinds) for y, ky in zip(keys[1], kinds))


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query(spark, sf, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert result(queries.op13_spelling_groups(spark, sf)) == want

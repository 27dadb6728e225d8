"""The operators against plain statements, on a small table and on odd rows."""

import hashlib
import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxmill.llm import embedding_dedup, line_dedup, mixing, packing, phrase_dedup, quality, queries, shingle_join, suffix_dedup, token_count, url_filter

rng = random.Random(7)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ".", ","]) for _ in range(n))


BASE, SHARED = prose(120), prose(70)
NEAR = BASE.split()
NEAR[7] = "other"
TEXTS = [
    None, "", " \t\n ", "one", "one two three", "One two three", BASE, BASE, " ".join(NEAR), prose(60) + "\n" + SHARED + "\n" + prose(50),
    SHARED + "\n" + prose(80), prose(30) + " " + SHARED, "line of five words here\n" * 40, "é ü 漢字 🎉 " * 30, "x" * 3000, prose(4000),
    "%%% *** ### " * 60, "a a a a a a a a", BASE.upper(),
]
CLASH = {"component_id": "bigint", "tkey": "string", "spans": "int", "n": "int", "kept": "string", "levels": "int", "rate": "double", "_id": "int"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{k} {v}" for k, v in CLASH.items())


def table(spark, texts, ids=None):
    rows = [(i, t, [None, "en", "de"][k % 3], ["hot", None, "b"][k % 3], len(t or ""), *[None] * len(CLASH)) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def repeated(spark):
    """Null ids, rows that come twice, one id with two texts."""
    return table(spark, [BASE, BASE, BASE, "some " + SHARED, "other " + SHARED, None], [None, None, 3, 3, 4, 4])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


OF_DOCUMENTS = {
    "line": lambda d: line_dedup.drop_similar_lines(d),
    "suffix": lambda d: suffix_dedup.drop_repeated_bytes(d, 100),
    "shingle": lambda d: shingle_join.join_shingles(d),
    "phrase": lambda d: phrase_dedup.drop_repeated_phrases(d, 20),
    "tokens": lambda d: token_count.count_tokens(d, public_tokenizers.path(queries.PIECES)),
}


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_and_repeated_rows(spark, name, empty, repeated):
    assert OF_DOCUMENTS[name](empty).count() == 0
    assert OF_DOCUMENTS[name](repeated).count() == repeated.count()


def test_suffix(odd):
    gone, runs = suffix_dedup.removed()
    found = suffix_dedup.drop_repeated_bytes(odd, 100).select("doc_id", "n_bytes", gone.alias("g"), runs.alias("s"), "kept_sha256")
    assert by_id(found, "n_bytes", "g", "s", "kept_sha256") == brute.repeated_bytes(list(enumerate(TEXTS)), 100)


def test_phrase(odd):
    found = phrase_dedup.drop_repeated_phrases(odd, 20).select("doc_id", "n_words", suffix_dedup.removed()[0].alias("g"), "kept_sha256")
    assert by_id(found, "n_words", "g", "kept_sha256") == brute.repeated_windows(list(enumerate(TEXTS)), 20)


def test_hot_anchors_are_cut_into_blocks(spark, monkeypatch):
    from voxmill.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK", 3)
    texts = [prose(k % 7 + 5) + " " + SHARED + " " + prose(k % 5 + 3) for k in range(24)]
    docs = table(spark, texts)
    gone, runs = suffix_dedup.removed()
    found = suffix_dedup.drop_repeated_bytes(docs, 100).select("doc_id", "n_bytes", gone.alias("g"), runs.alias("s"), "kept_sha256")
    assert by_id(found, "n_bytes", "g", "s", "kept_sha256") == brute.repeated_bytes(list(enumerate(texts)), 100)
    found = phrase_dedup.drop_repeated_phrases(docs, 20).select("doc_id", "n_words", gone.alias("g"), "kept_sha256")
    assert by_id(found, "n_words", "g", "kept_sha256") == brute.repeated_windows(list(enumerate(texts)), 20)


def test_shingles(spark):
    texts = TEXTS + [" ".join(w if rng.random() > p else "zz" for w in BASE.split()) for p in (0.002, 0.005, 0.01, 0.02) for _ in range(8)]
    found = shingle_join.join_shingles(table(spark, texts), 4, 85, 100)
    assert by_id(found, "n_shingles", "component_id") == brute.shingle_join(list(enumerate(texts)), 4, 85, 100)


@pytest.mark.parametrize("num", [80, 85])
def test_signatures_lose_no_pair(num):
    for size in (1, 4, 7, 12, 30, 90, 250, 700, 5000):
        for _ in range(40 if size < 5000 else 5):
            a = {rng.getrandbits(64) for _ in range(size)}
            b = set(rng.sample(sorted(a), max(1, int(size * rng.uniform(num / 100, 1)))))
            b |= {rng.getrandbits(64) for _ in range(int((size - len(b)) * rng.random()))}
            x, y = (shingle_join.np.array(sorted(s), "u8") for s in (a, b))
            if shingle_join.same_share(x, y, num, 100):
                mine, other = (shingle_join.signatures(z, num, 100) for z in (x, y))
                assert set(mine.tolist()) & set(other.tolist()) and len(mine) < 3 * size + 30


def test_lines(spark, odd):
    words = [f"v{k}" for k in range(60)]
    texts = TEXTS + ["\n".join(" ".join(rng.sample(words[k : k + 14], 12)) for k in range(0, 40, 4)) for _ in range(12)]
    goes = brute.similar_lines(list(enumerate(texts)), 80, 100, 1)
    found = line_dedup.drop_similar_lines(table(spark, texts))
    assert set(TEXT_COLUMNS) <= set(found.columns)
    for i, text, n in found.select("doc_id", "text", "n_lines_gone").collect():
        gone = set(goes.get(i, ()))
        assert n == len(gone)
        assert text == (None if texts[i] is None else "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone))


@pytest.mark.parametrize("num", [50, 80])
def test_short_lines(spark, num):
    """Repeats of lines of one to four words go; four words are similar to the same and one more."""
    own = ["home", "a b", "b a", "a b c", "a b c d", "a b c d e", "d c b a f g", "p q r s t", "p q r s", "u v w", "u v", " ", ""]
    texts = ["\n".join(own), None, "home\nhome\n\nnew", "\n".join(rng.sample(own, len(own))), "home"]
    goes = brute.similar_lines(list(enumerate(texts)), num, 100, 1)
    found = line_dedup.drop_similar_lines(table(spark, texts), num=num)
    for i, text, n in found.select("doc_id", "text", "n_lines_gone").collect():
        gone = set(goes.get(i, ()))
        assert n == len(gone)
        assert text == (None if texts[i] is None else "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone))


TEXT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", *CLASH)


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(TEXTS))] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    judged = quality.quality_rules(odd, labels)
    counts = by_id(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert counts == {k: brute.quality_counts(t) for k, t in enumerate(TEXTS)}
    assert judged.filter("kept = base_failed").count() == 0  # too few labels certify nothing
    assert quality.keep_good(odd, judged).columns == odd.columns
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(odd, labels.limit(0)).count() == len(TEXTS)


def test_certified_cutoffs_hold(spark):
    from math import comb

    def tail(n, k, p):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    cases = [(n, k) for n in (1, 30, 400, 2500) for k in (0, 1, 3, 7, 20) if k <= n]
    got = spark.createDataFrame(cases, "n bigint, k bigint").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()
    for n, k, p in got:
        assert p == pytest.approx(tail(n, k, 0.01) if k <= n * 0.01 else 1.0, rel=1e-9)


def test_verdicts_equal_brute_force(spark):
    """Cutoffs and ``kept`` from plain loops over strata, rules and cutoffs, with exact sums."""
    from fractions import Fraction
    from math import comb

    own, rules, risk, doubt = random.Random(5), {"symbols": (0.05, 0.2, 0.8), "capitals": (0.1, 0.3)}, 0.1, 0.05
    sizes = {"many": 400, "some": 110, "few": 40, None: 150}
    rows = []
    for stratum, n in sizes.items():
        for k in range(n):
            symbols = 0.5 if own.random() < 0.02 else own.choice((0.0, 0.01, 0.05))
            capitals = 0.2 if own.random() < (0.5 if stratum == "many" else 0.0) else 0.0
            rows.append((len(rows), stratum, (symbols, capitals), k % 17 == 0))
    rows += [(len(rows) + k, s, (2.0, 0.9), False) for k, s in enumerate([*sizes, "none"])]  # no label
    labels = [(r[0], 1) for r in rows[:-5]] + [(0, 0), (None, 1), (1, None)]
    shape = "doc_id bigint, stratum string, measures struct<symbols: double, capitals: double>, base_failed boolean"
    measured = spark.createDataFrame(rows, shape)
    cutoffs = quality.certify(measured, spark.createDataFrame(labels, "doc_id bigint, quality int"), risk, doubt, rules)

    p, want = Fraction(risk) / len(rules), {}
    for stratum in sizes:
        held = [r[2] for r in rows[:-5] if r[1] == stratum and r[0] != 0]
        for place, (rule, cuts) in enumerate(rules.items()):
            for cut in sorted(cuts, reverse=True):
                n, k = len(held), sum(m[place] > cut for m in held)
                chance = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1
                if chance > doubt / (len(sizes) * len(rules)):
                    break
                want[stratum, rule] = cut
    assert {(r.stratum, r.rule): r.cutoff for r in cutoffs.collect()} == want
    assert want["many", "capitals"] == 0.3 and ("few", "symbols") not in want and (None, "capitals") in want
    kept = {r.doc_id: r.kept for r in quality.judge(measured, cutoffs).collect()}
    assert kept == {i: not failed and not any(v > want.get((s, r), 9) for r, v in zip(rules, m)) for i, s, m, failed in rows}


def test_urls(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("b.org", "/a", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://WWW.Example.com/en/x?y", "https://a.example.com/en/", "http://example.com", "http://example.com/", "ftp://notexample.com/en/1", "http://x.net/es/1#q", "http://b.org/abc", "http://b.org/b", None, "nothing", "http://", "http://x.net/es/1#q"]
    pages = spark.createDataFrame([(k, u, 1, "x") for k, u in enumerate(urls)], "page_id bigint, url string, rule int, best string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    block = {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: (None, "allow"), 3: ("com/", "allow"), 4: ("com/", "allow"), 5: ("net/es/", "block"), 6: ("b.org/a", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: ("net/es/", "block")}
    assert got == block
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).filter("rule is not null").count() == 0


def test_mixing(spark, empty):
    docs = table(spark, [f"text {k}" for k in range(3000)])
    mixed = mixing.mix_sources(docs)
    counts = {r[0]: r[1] for r in mixed.groupBy("source").count().collect()}
    assert all(abs(n - 1000) < 5 * 1000**0.5 for n in counts.values()) and len(counts) == 3
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    many = mixing.mix_sources(docs, spark.createDataFrame([("b", 1.0)], "source string, weight double"), total=300_000)
    got = {r[0]: r[1] for r in many.groupBy("source").count().collect()}
    assert set(got) == {"b"} and abs(got["b"] - 300_000) < 5 * 300_000**0.5
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("size", [8, 64])
def test_cuts_cost_least(size):
    for _ in range(60):
        at, cost = [0], [0]
        while len(at) < 14:
            at.append(at[-1] + rng.randint(1, size))
            cost.append(rng.choice([0, 3, 9]))
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + packing.sequence_cost(at[j] - at[i], size) + cost[j] for i in range(j) if at[j] - at[i] <= size)
        cuts = packing.best_cuts(packing.np.array(at), packing.np.array(cost), size)
        spent, last = 0, 0
        for j in cuts:
            spent += packing.sequence_cost(at[j] - at[last], size) + cost[j]
            last = j
        assert last == len(at) - 1 and spent == best[last]


def test_packing(spark, odd, empty, repeated):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    encode = Tokenizer.from_file(path).encode
    texts = [*TEXTS, "ΟΔΟΣ Σ ΑΣ. İstanbul ﬁn K éa don't I'LL it's, <|endoftext|>x a_b 12a Å ١٢ ²", "q" * 5000]
    for block in (500, 1 << 21):
        found = packing.pack(table(spark, texts), path, block_tokens=block)
        pieces = [tuple(r) for r in found.select("doc_id", "start", "length", packing.piece_digest(), "doc_tokens", "sequence_id", "offset").collect()]
        brute.packed(list(enumerate(texts)), lambda t: encode(t, add_special_tokens=False).ids, 1, 2048, pieces)
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(repeated, path).agg(F.sum("length")).first()[0] > 0


def test_words_of_all_scripts_have_the_tokenizers_ids():
    """Letters that turn into a letter and a mark take the punctuation along."""
    from struct import unpack

    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    encode, words = Tokenizer.from_file(path).encode, packing.words_of(path)
    letters = [c for c in map(chr, [*range(0x41, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0xFE00), *range(0x10000, 0x11000)]) if c.isalpha()]
    marks = [chr(c) for c in (0x300, 0x301, 0x307, 0x345, 0x5BC, 0x93C)]
    own = ["\u0130,", "A\u0130.", "\u092a\u095d,", "\ufb2a,", "\u0130", "e\u0301!", "\u03a3.", "\u1e9e?"]
    own += [c + "," for c in letters]
    own += ["".join(rng.choices(letters, k=rng.randint(1, 4))) + rng.choice(["", "", rng.choice(marks)]) + "".join(rng.choices(".,;:!?", k=rng.randint(0, 2))) for _ in range(20_000)]
    for word in own:
        found = words[word.encode()]
        assert list(unpack(f"<{len(found) // 4}I", found)) == encode(word, add_special_tokens=False).ids, word


def test_token_counts_equal_the_tokenizers(spark, odd):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path(queries.PIECES)
    pieces = token_count.ranked_pieces(path)
    # The tokenizer's byte pieces score so low that they never count as text.
    low = min(s for _, s in pieces)
    vocabulary = [("<unk>", 0.0), *pieces, *((f"<0x{k:02X}>", low) for k in range(256))]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    found = by_id(token_count.count_tokens(odd, path), "n_words", "n_tokens")
    for k, text in enumerate(TEXTS):
        own = brute.words(text)
        assert found[k] == (len(own), sum(len(tokenizer.encode(token_count.SPACE + w).ids) for w in own))


def test_names_of_special_pieces_are_text(spark):
    texts = ["<unk>", "</s>", "<0x41>", "\U0001F9FF", "a" * 9]
    path = public_tokenizers.path(queries.PIECES)
    counter = token_count.Counter(token_count.ranked_pieces(path), True)
    found = by_id(token_count.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path), "n_tokens", "n_unknown")
    assert token_count.falls_back(path)
    assert all(found[k][0] > 1 for k in range(3)) and found[3] == (1 + 4, 1)
    assert {k: counter.count("▁" + t) for k, t in enumerate(texts)} == found


def test_a_word_of_any_length_takes_little_memory():
    """Only as many places are held as the longest piece is long; besides, the automaton takes
    a copy of the word, four bytes a character."""
    import tracemalloc

    pieces = [("▁", -1.0), ("ab", -1.5), ("aba", -1.0), ("b", -3.0)]
    counter = token_count.Counter(pieces)
    word = "▁" + "abab漢" * 100_000
    tracemalloc.start()
    assert counter.count(word) == (1 + 3 * 100_000, 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(word)


def test_ties_of_token_counts():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", -9.0)] + [(p, float(-rng.randint(1, 3))) for p in ("▁", "a", "b", "ab", "ba", "aba", "bab", "▁a", "aa", "c")]
    counter, tokenizer = token_count.Counter(pieces), Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    for _ in range(400):
        word = "".join(rng.choice("aabbcxy") for _ in range(rng.randint(1, 12)))
        assert counter.count("▁" + word)[0] == len(tokenizer.encode("▁" + word).ids)


def test_embeddings(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(40, 8))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, base[:20] + r.normal(size=(20, 8)) * 0.2, base[:5], base[:3] * 2]))]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] + [1.0] * 7), (104, [None] + [1.0] * 7), (105, [1.0, 2.0]), (106, [2.0, 4.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cid string")
    for block in (4096, 7):
        found = {x[0]: tuple(x)[1:] for x in embedding_dedup.link_embeddings(vectors, block=block).collect()}
        assert found == brute.embeddings(rows)
    assert embedding_dedup.link_embeddings(vectors.limit(0)).count() == 0
    assert embedding_dedup.link_embeddings(vectors.filter("vec_id = 100").withColumn("vec_id", F.lit(None).cast("long"))).count() == 1


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "shingle join", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, sf)
        assert docs_out.columns == docs.columns and 0 < docs_out.count()
        docs = docs_out
    assert hashlib and corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_equals_plain_statements(spark, tmp_path):
    """Ids and texts after every stage, one stage on what the one before it left."""
    from collections import Counter
    from math import exp

    import corpus_pipeline
    from tokenizers import Tokenizer

    own = random.Random(11)

    def cut(words, width):
        return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))

    texts = []
    for k in range(24):
        words = [f"{own.choice('abcdefgh')}{own.randrange(500)}" for _ in range(own.randint(55, 140))]
        near = words[:-1] + ["other"]
        texts += ["home\n" + cut(words, 9) + "\nread more", " ".join(words), cut(near, 10 + k % 3), cut(words[:20], 9)]
    texts += [texts[0], texts[1], None, "", "home", "a b c " * 40, "é 漢字\n" + " ".join(f"q{k}" for k in range(60))]
    rows = [(3 * k, t, "en", ["s", "t", None][k % 7 % 3], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)

    def step(name, docs):
        path = f"{tmp_path}/{name}"
        stages[name](spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        return docs, sorted(map(tuple, docs.collect()), key=str)

    docs, got = step("quality rules", spark.read.parquet(f"{sf}/documents.parquet"))
    want = [r for r in rows if not brute.quality_counts(r[1])[5]]
    assert got == sorted(want, key=str) and len(want) < len(rows)

    docs, got = step("line dedup", docs)
    goes, left = brute.similar_lines([r[:2] for r in want], 80, 100, 1), []
    for i, text, lang, source, n in want:
        gone = set(goes.get(i, ()))
        text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        if not gone or brute.words(text):
            left.append((i, text, lang, source, len(text) if gone else n))
    assert got == sorted(left, key=str) and len(left) < len(want)

    docs, got = step("shingle join", docs)
    found = brute.shingle_join([r[:2] for r in left], 5, 80, 100)
    stay = [r for r in left if found[r[0]][1] == r[0]]
    assert got == sorted(stay, key=str) and len(stay) < len(left)

    docs, got = step("mixing", docs)
    sizes, mix = Counter(r[3] for r in stay), []
    for r in stay:
        mean = len(stay) / len(sizes) / sizes[r[3]]
        u = int(hashlib.md5(f"1|1|{r[0]}".encode()).hexdigest()[:13], 16) / 16**13
        n, p, total = 0, exp(-mean), exp(-mean)
        while total <= u:
            n += 1
            p *= mean / n
            total += p
        mix += [r] * n
    assert got == sorted(mix, key=str) and max(Counter(mix).values()) > 1

    docs, got = step("packing", docs)
    assert docs.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    pieces, begun = [], Counter()
    for i, start, length, crc, n, seq, offset in docs.select("doc_id", "start", "length", packing.piece_digest(), "doc_tokens", "sequence_id", "offset").orderBy("sequence_id", "offset").collect():
        begun[i] += start == 0
        pieces.append(((i, begun[i]), start, length, crc, n, seq, offset))
    copies, again = [], Counter()
    for r in mix:
        again[r[0]] += 1
        copies.append(((r[0], again[r[0]]), r[1]))
    encode = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE)).encode
    brute.packed(copies, lambda t: encode(t, add_special_tokens=False).ids, 1, 2048, pieces)

"""What a reviewer found in the third round."""

import random
import time
from pathlib import Path
from string import punctuation

import pandas as pd
import public_tokenizers

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from voxmill.llm import common, line_dedup, packing, phrase_dedup, shingle_join
from voxmill.operators import analyser
from voxmill.session import shared_root, stored_once
from workload import all_queries

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, path, *texts, parts=1):
    rows = [(k, text, "en", "web", len(text)) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    sf = documents(spark, tmp_path, "one", "two", "one", "three", parts=3)
    out = all_queries()["str1_collect_stream"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 3]


def test_quadrants_are_counted(spark, sf):
    out = all_queries()["win1_quadrants"](spark, sf).collect()
    by_quadrant = {}
    for r in out:
        by_quadrant.setdefault(r.quadrant, []).append(r.category)
    assert out and all(r.categories == len(by_quadrant[r.quadrant]) for r in out)


def test_labels_are_named_whatever_else_is_wrong(spark, tmp_path):
    sf = documents(spark, tmp_path, *(f"title {k}\nreply" for k in range(23)))
    out = [(r.thread_id, r.problem, r.label_names) for r in all_queries()["arr5_label_names"](spark, sf).collect()]
    assert sorted(x for x in out if x[1] is None) == sorted((str(k), None, "en,web") for k in range(23))
    assert [x for x in out if x[1] == "unreadable"] == [(None, "unreadable", None)] * 3  # 0, 11, 22
    assert sorted(x for x in out if x[1] == "no author") == [(k, "no author", "en,web") for k in ("10", "20")]


def test_findings_of_many_batches_leave_a_worker_together():
    pages = pd.DataFrame({"id": range(5000), "title": None, "page": 0, "n_pages": 1, "text": [f"t{k}" for k in range(5000)]})
    asked = []

    def analyse(some):
        asked.append(len(some))
        return [{"pain_points": [p["text"]]} for p in some[:-1]]  # an answer too few

    out = list(analyser._asker(analyse, ["id"], 7)(iter([pages])))
    assert max(asked) == 7 and sum(asked) == 5000 and len(out) == 5
    found = pd.concat(out)
    assert list(found["id"]) == list(range(5000)) and found["answered"].sum() == 5000 - len(asked)
    assert all(p == [f"t{k}"] for k, p, yes in zip(found["id"], found["pain_points"], found["answered"]) if yes)


def test_words_are_joined_as_they_are_split(spark):
    texts = [None, "", " ", "\n\t", "a", " a  b\n\nc\td ", "a\r\nb\x0bc\x0c", "\u00a0x \u2003 y", "\u4e2d \u6587", "a\x00 b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        common.spaced(F.col("text")).alias("got"), F.array_join(common.words(F.col("text")), " ").alias("wanted")
    )
    assert [r.got for r in rows.collect()] == [r.wanted for r in rows.collect()]


def test_repeated_phrases_of_null_ids_and_odd_gaps(spark):
    phrase = " ".join(f"w{k}" for k in range(25))
    rows = [(None, phrase), (1, "head " + phrase.replace(" ", "  ")), (1, "other text"), (2, None), (3, phrase.replace(" ", "\n") + " tail")]
    cut = phrase_dedup.drop_repeated_phrases(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r.doc_id or 0), r.n_words, sum(s.hi - s.lo for s in r.spans)) for r in cut.collect())
    assert got == [(0, 25, 0), (1, 2, 0), (1, 26, 25), (2, 0, 0), (3, 26, 25)]


def test_a_stored_step_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def kept():
        files = {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}
        return {f for f in files if f.exists() and f.stat().st_size > 50_000}

    before, df = kept(), spark.range(1_000_000).repartition(4, "id")
    table = stored_once(df, "numbers")
    deadline = time.time() + 10
    while kept() - before and time.time() < deadline:  # files go in the background
        time.sleep(0.2)
    assert not kept() - before
    assert table.count() == df.count() == 1_000_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def stored_names(spark):
    return {f.name for f in Path(shared_root(spark).removeprefix("file:")).iterdir()}


def test_tables_of_ended_steps_of_line_dedup_go(spark):
    rng = random.Random(7)
    line = [f"w{k}" for k in range(40)]
    near = [" ".join(rng.sample(line, 36)) for _ in range(6)]
    rows = [(None, near[0]), (1, "\n".join(near)), (1, "\n".join([*near, near[0]])), (2, near[3]), (2, near[3]), (3, None), (4, " \n")]
    before, docs = stored_names(spark), spark.createDataFrame(rows, "doc_id bigint, text string")
    goes = line_dedup.similar_lines(docs)
    assert {n.split("-")[0] for n in stored_names(spark) - before} == {"goes"}
    texts = [r.text for r in goes.join(docs.filter("doc_id = 2"), "doc_id").collect()]
    assert texts and set(texts) == {near[3]}
    left = line_dedup.drop_similar_lines(docs)
    assert left.count() == 7 and left.filter("doc_id IS NULL AND n_lines_gone = 0").count() == 1
    assert [r.n_lines_gone for r in left.filter("doc_id = 2").collect()] == [1, 1]


def test_copies_are_linked_by_their_sets_and_steps_leave_no_tables(spark, monkeypatch):
    rng, asked = random.Random(3), []
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words)] * 5 + [" ".join(w if rng.random() > 0.02 else "zz" for w in words) for _ in range(8)]
    texts += [texts[6], texts[7].upper(), texts[7], None, " ", "a b", "A  b"]
    linked = shingle_join._linked

    def spy(pairs, *more):
        asked.extend(pairs.collect())
        return linked(pairs, *more)

    monkeypatch.setattr(shingle_join, "_linked", spy)
    before, docs = stored_names(spark), spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = shingle_join.join_shingles(docs, 4, 85, 100)
    assert {n.split("-")[0] for n in stored_names(spark) - before} == {"sizes", "edges", "roots"}
    sets = [(texts[i] or "").lower().split() for i in range(len(texts))]
    assert asked and all(sets[p.a] != sets[p.b] for p in asked)
    assert by_id(found, "n_shingles", "component_id") == brute.shingle_join(list(enumerate(texts)), 4, 85, 100)


def test_an_id_with_a_copy_and_a_text_of_its_own_keeps_both_links(spark):
    rng = random.Random(5)
    one, two = ([f"{x}{k}" for k in range(80)] for x in "ab")
    close = [" ".join(w if k != rng.randrange(80) else "q" for k, w in enumerate(ws)) for ws in (one, two)]
    rows = [(1, " ".join(one)), (5, " ".join(one)), (5, " ".join(two)), (7, close[1]), (8, close[0]), (9, " ".join(two)), (None, " ".join(two))]
    found = shingle_join.join_shingles(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80, 100)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, 1) for i in (1, 5, 7, 8, 9)} | {(None, None)}


def test_near_copies_of_many_buckets_meet_in_one(spark):
    roots = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    members = spark.createDataFrame([(s, i, r) for s in range(40) for i, r in roots.items()], "sign bigint, id bigint, root bigint")
    sizes = spark.createDataFrame([(i, 100, [0] * 9) for i in roots], "doc_id bigint, n int, sketch array<bigint>")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = shingle_join._across(members, sizes, 85, 100)
        wanted = {(max(a, b), min(a, b)) for a in roots for b in roots if roots[a] != roots[b]}
        assert {(r.a, r.b) for r in pairs.collect()} == wanted
        node = pairs._jdf.queryExecution().executedPlan()
        while "Join" not in node.nodeName():
            node = node.children().head()
        assert node.metrics().apply("numOutputRows").value() <= 2 * len(wanted)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_letters_before_any_marks_are_told_apart_without_the_whole_tokenizer(monkeypatch):
    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    encode, rng, asked = words.encode, random.Random(9), []
    texts = [s + "".join(rng.choices(punctuation, k=rng.randrange(1, 5))) for s in ("Eden", "\u00c9ach\u00e7", "'s", "it's", "a1", "\u0130x", "") for _ in range(60)]
    texts += ["<|endoftext|>", "x<|endoftext|>", "e\u0301$$", "a'", "'t'", "\u03a3\u03a3&&"]
    for text in texts:
        assert words[text.encode()] == packing.pack_numbers(f"<{len(ids := encode(text, add_special_tokens=False).ids)}I", *ids), text
    words.encode = lambda text, **more: asked.append(text) or encode(text, **more)
    for k in range(20):
        words[("Eden" + "b" * k + "***").encode()]
    assert set(asked) <= {"***"}
    found, ends = packing.encode_sentences("One, two. Three!\n\u00e9? x".encode(), words)
    parts = [len(encode(t, add_special_tokens=False).ids) for t in ("One, two.", "Three!", "\u00e9?", "x")]
    assert ends == [sum(parts[: k + 1]) for k in range(3)] and len(found) == 4 * sum(parts)


def test_the_pipeline_keeps_only_the_table_of_its_last_stored_stage(spark, tmp_path, monkeypatch):
    stages = [(name, lambda spark, docs, sf_dir: docs) for name in ("one", "two", "three")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages, ("four", lambda spark, docs, sf_dir: docs.select("doc_id"))])
    documents(spark, tmp_path, "a b", "c d")
    before = stored_names(spark)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1]
    assert {n.split("-")[0] for n in stored_names(spark) - before} == {"three"}

"""Cleaning steps against golden cases, plain rules and hostile texts."""

import random
import time
from functools import partial

import pytest
import rules
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxmill.functions import text as T
from voxmill.functions.whitespace import WHITESPACE
from workload.views import SNIPPETS

TOKENS = [
    "a", "b ", "On Mon, x wrote:", "On ", ", ", " wrote:", "*", "**", "_", "__", "`", "```", "\n", "\r\n",
    "\r", "\x85", "\xa0", "\x1c", "\x0b", " ", "　", "-", "--", "---", "  ", "\t", "[x](y)",
    "![i](j)", "![", "](", "[", "]", "(", ")", "!", ">", "é", "\U0001d11e", "foo_bar", "\n> q\n", "\nLogs\n",
    "\nloGſ x\n", "_No response_", "\n### operating System 1\n", "\nAcme version 2\n", "$1", "\\",
    "```json", "{", "}",
]

GOLDEN = [
    (0, "tail"),
    (1, "Linux\ntail"),
    (2, "tail"),
    (3, "tail"),
    (4, "tail"),
    (5, "run and the docs tail"),
    (6, "bold and it and u and v foobarbaz\ntail"),
    (7, "reply\ntail"),
    (8, "hi\ntail"),
    (9, "sig \nafter\ntail"),
    (10, "a\n\nb c d\ntail"),
    (11, "[n](w) x` Logs\n tail"),
]


def apply(spark, texts, expression):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in frame.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(TOKENS, k=rng.randint(0, 14))) for _ in range(n)]


def test_white_space_is_pythons():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_golden(spark):
    out = apply(spark, [SNIPPETS[k] + "tail" for k, _ in GOLDEN], T.clean_text)
    assert out == [expected for _, expected in GOLDEN]


def test_missing_and_empty_text(spark):
    assert apply(spark, [None, "", " \n"], T.clean_text) == ["", "", ""]


def test_html_only_for_the_forum(spark):
    rows = spark.createDataFrame([("Discourse", "<p>a</p>b"), ("GitHub", "<p>a</p>b"), (None, "<b>")], "s string, b string")
    out = [r[0] for r in rows.select(T.clean_text(F.col("b"), F.col("s"))).collect()]
    assert out == ["a b", "<p>a</p>b", "<b>"]


@pytest.mark.parametrize("name", rules.RULES)
def test_step_follows_its_rule(spark, name):
    step = getattr(T, name)
    if name == "drop_boilerplate":
        step = partial(step, product=rules.PRODUCT)
    texts = random_texts(3000, name)
    assert apply(spark, texts, step) == [rules.RULES[name](t) for t in texts]


def test_chain_follows_the_rules(spark):
    texts = random_texts(8000, "chain")
    out = apply(spark, texts, lambda c: T.clean_text(c, product=rules.PRODUCT))
    assert out == [rules.clean(t) for t in texts]
    for cleaned in out:
        assert "\n\n\n" not in cleaned and "  " not in cleaned and cleaned == cleaned.strip()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.text(), st.text(alphabet="*_-`[]()!>\n ,O.nw")), min_size=50, max_size=200))
def test_chain_on_any_text(spark, texts):
    # A lone surrogate is no text Spark can hold.
    texts = [t for t in texts if t.isprintable() or t.encode("utf-8", "ignore").decode() == t]
    out = apply(spark, texts, lambda c: T.clean_text(c, product=rules.PRODUCT))
    assert out == [rules.clean(t) for t in texts]


def test_json_fence(spark):
    texts = random_texts(4000, "fence") + ["```json\n[1]\n```", "```json [1] ```\nx", "  [1]  "]
    assert apply(spark, texts, T.strip_json_fence) == [rules.strip_fence(t) for t in texts]


def test_prefixes_are_a_parameter(spark):
    only = partial(T.drop_boilerplate, prefixes=("Steps",))
    assert apply(spark, ["Logs\nsteps: a\nb"], only) == ["Logs\nb"]
    assert apply(spark, ["Logs\nb"], partial(T.drop_boilerplate, prefixes=())) == ["Logs\nb"]
    assert apply(spark, ["Acme version 1\nb"], T.drop_boilerplate) == ["Acme version 1\nb"]


@pytest.mark.parametrize(
    "unit",
    ["![", "[", "[x](", "![a](", "`", "**", "_", "-", "- ", "\t", "　", ", ", "On a, ", "<", "<!--", "<a ", "<a '", "&", "&#", "> ", "\n>"],
)
def test_hostile_texts_take_linear_time(spark, unit):
    text = "On a" + unit * (1_000_000 // len(unit)) + "x"
    start = time.time()
    apply(spark, [text], lambda c: F.length(T.clean_text(c, F.lit("Discourse"))))
    apply(spark, [text], lambda c: F.length(T.clean_text(c)))
    apply(spark, ["```" + text], lambda c: F.length(T.strip_json_fence(c)))
    assert time.time() - start < 20

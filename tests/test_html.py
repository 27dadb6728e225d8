"""HTML to text against Python's own parser and by example."""

from html.parser import HTMLParser

from support import SMALL
from pyspark.sql import functions as F
from test_text import apply

from voxmill.functions.html import decode_entities, html_to_text


class Nodes(HTMLParser):
    """Text nodes outside script, style and template."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.nodes, self.node = 0, [], ""

    def cut(self):
        self.nodes.append(self.node.strip())
        self.node = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.cut()
        self.hidden -= tag in ("script", "style", "template")

    def handle_comment(self, data):
        self.cut()

    def handle_decl(self, decl):
        self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.node += data


def parsed(html):
    parser = Nodes()
    parser.feed(html)
    parser.close()
    parser.cut()
    return " ".join(n for n in parser.nodes if n)


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = pages.select("html", html_to_text(F.col("html")).alias("text")).collect()
    assert rows and all(r.text == parsed(r.html) for r in rows)


def test_markup(spark):
    cases = {
        "plain  text ": "plain  text",
        "<p>one</p><p> two </p>": "one two",
        "a<br/>b": "a b",
        "x <!-- <p>no</p> --> y": "x y",
        "x<script>var t='<p>';</script>y": "x y",
        "<style>p{}</style>z<template><b>t</b></template>": "z",
        "<a title='a > b' href=\"c>d\">link</a>": "link",
        "<a title='open>link</a>": "link",
        "5 < 6 and 7 > 3": "5 < 6 and 7 > 3",
        "end <b": "end <b",
        "<!DOCTYPE html><?xml ?>q": "q",
        "x <!-- never closed": "x",
        "x <script> never closed": "x",
        "<SCRIPT>a</SCRIPT>b": "b",
        "": "",
    }
    assert apply(spark, list(cases), html_to_text) == list(cases.values())


def test_references(spark):
    cases = {
        "a &amp; b": "a & b",
        "&amp;lt;": "&lt;",
        "&lt;p&gt; &quot;q&quot; &copy;&middot;": '<p> "q" ©·',
        "&#39;&#x41;&#X42;": "'AB",
        "&#128;&#150;": "€–",
        "&#0;&#xD800;&#99999999999;": "���",
        "&#x1D11E;": "\U0001d11e",
        "&hellip;&NotEqualTilde;": "…≂̸",
        "&copy 2024": "© 2024",
        "AT&T & co": "AT&T & co",
        "&unknown;x": "&unknownx",
        "&": "&",
        "&&amp;&": "&&&",
    }
    assert apply(spark, list(cases), decode_entities) == list(cases.values())

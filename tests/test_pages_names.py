"""Readable lines of pages against a parser's walk, and names by what they hold against a plain search."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from fablespark.functions import html
from fablespark.operators import catalog


class Walk(HTMLParser):
    """The same text by a parser: depth of skipped elements, a line end for each block."""

    def __init__(self):
        super().__init__()
        self.out, self.depth = [], 0

    def add(self, s):
        if not self.depth:
            self.out.append(s)

    def handle_starttag(self, tag, attrs):
        if tag in html.SKIPPED:
            self.depth += 1
        elif tag in ("h1", "h2", "h3"):
            self.add("\n\n")
        elif tag in ("p", "div", "br", "h4", "h5", "h6"):
            self.add("\n")

    def handle_endtag(self, tag):
        if tag in html.SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.add("\n")

    def handle_data(self, data):
        if self.lasttag not in ("script", "style") or self.cdata_elem is None:
            self.add(data)


def walked(page):
    walk = Walk()
    walk.feed(page)
    walk.close()
    return re.sub(" +", " ", re.sub(r"\n{3,}", "\n\n", "".join(walk.out))).strip()


PAGES = [
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><nav>';</script></head><body><p>one<br>two</p></body></html>",
    "<nav>a<nav>b</nav>c</nav>d<header><h1>x</h1></header>",
    "</nav>kept<footer>gone",
    '<p title="a>b">x</p><a href=\'>\'>y</a>',
    "a &lt;b&gt; &amp;amp; &#233;&#xE9; &#128512; &eacute;&nbsp;&unknown; &",
    "<h1>Title</h1>  <h2>Sub</h2><div><div>deep</div></div>",
    "1 < 2 <!-- <p>no</p> --> 3",
    "<P>UP</P><Script>x</SCRIPT>y<SCRIPT src='q'></script>z",
    "",
    "no tags   at all\n\n\n\nend",
]


def test_page_lines(spark):
    r = random.Random(6)
    bits = ["<p>", "</p>", "<div class='k'>", "</div>", "<nav>", "</nav>", "<header>", "</header>", "<b>", "</b>", "<br/>", "<h1>", "</h1>", "text", " ", "\n", "&amp;", "<!-- c -->", "<style>p{}</style>", "<script>if(a<b){'</p>'}</script>", "é"]
    pages = PAGES + ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)]
    frame = spark.createDataFrame([*enumerate(pages), (-1, None)], "i int, t string")
    got = {x.i: x.l for x in frame.select("i", html.page_lines("t").alias("l")).collect()}
    assert got.pop(-1) is None
    assert got == {i: walked(p) for i, p in enumerate(pages)}


def test_long_page(spark):
    """A page of megabytes, with a long attribute, runs through without deep recursion."""
    page = "<div data='" + "x" * 500_000 + "'>" + "<p>word &amp; more</p>" * 50_000 + "<nav>" * 200 + "gone" + "</nav>" * 200 + "end"
    [row] = spark.createDataFrame([(page,)], "t string").select(html.page_lines("t").alias("l")).collect()
    assert row.l.count("word & more") == 50_000 and row.l.endswith("end") and "gone" not in row.l


def test_found_by_name(spark):
    r = random.Random(8)
    names = ["".join(r.choice("abAB é") for _ in range(r.randrange(9))) for _ in range(120)] + [None]
    entries = [(n, i // 2, f"v{i}") for i, n in enumerate(names)]
    asked = [(i, n) for i, n in enumerate([*names[:20], None, "", "a", "AB", "zzzz", "abab", "é", "bab", "BABA"] + ["".join(r.choice("abé ") for _ in range(r.randrange(7))) for _ in range(200)])]
    frames = spark.createDataFrame(asked, "i int, name string"), spark.createDataFrame(entries, "name string, ord int, voice string")
    out = catalog.found_by_name(*frames, "name", "ord", "voice")

    def by_hand(name):
        if name is None:
            return None
        best = lambda test: min(((o, n, v) for n, o, v in entries if n is not None and test(n)), default=(0, "", None))[2]
        return best(lambda n: n == name) or best(lambda n: name.lower() in n.lower())

    assert {x.i: x.voice for x in out.collect()} == {i: by_hand(n) for i, n in asked}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where(F.col("voice").isNull()).count() >= 2

"""Blocks, features and tree; pages that the labelled table does not hold; edges."""

import re

import numpy as np
import pytest

from chronospan.llm import html_extract as he

TREE = he.train()


def test_tree_learns_its_table():
    x, y = he.labelled_blocks(he.LABELLED)
    assert len(y) > 100 and ((TREE.predict(x) > 0.5) == y).mean() > 0.98


def test_tree_against_every_split():
    """The first question is the best of all."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(60) < 0.1)).astype(float)
    tree = he.fit_tree(x, y, depth=1)
    gini = lambda v: v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    costs = {(f, t): gini(y[x[:, f] <= t]) + gini(y[x[:, f] > t]) for f in range(3) for t in np.arange(0.5, 5)}
    assert costs[int(tree.feature[0]), float(tree.threshold[0])] == pytest.approx(min(costs.values()))
    assert len(he.fit_tree(x, np.ones(60)).value) == 1


PAGES = {
    "plain": ("<body><nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>One &amp; two.</p><p>Short</p></article><footer>&copy; us</footer>", ["A title", "One & two.", "Short"]),
    "no article": ("<div class='top menu'><a href=/>Home</a> <a href=/n>News</a></div><div id=content><h2>Title here</h2><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p></div><div class=footer>All rights reserved</div>", ["Title here", ("word " * 60).strip(), ("more " * 40).strip()]),
    "comments": ("<main><h1>Big news</h1><p>" + "text " * 30 + "</p></main><section class='comments'><article><p>" + "I think " * 20 + "</p></article></section>", ["Big news", ("text " * 30).strip()]),
    "asides": ("<article><h1>T</h1><p>" + "a " * 20 + "</p><aside><p>" + "b " * 30 + "</p></aside><p>end</p><form>Your name <input> <button>Send</button></form></article>", ["T", ("a " * 20).strip(), "end"]),
    "scripts": ("<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {}</style><article><p>only <b>this</b> te<i>xt</i>&hellip;<!-- <p>not</p> --><br>here</p><noscript>js</noscript></article><script>open", ["only this text… here"]),
    "unclosed": ("<nav><ul><li><a href=/>x</a><article><h1>T t<p><b>First part.<br><p>Second <a href='a>b'>one</a> of some words that go on.</article><footer>foot", ["T t", "First part.", "Second one of some words that go on."]),
    "sidebar": ("<div class=wrap><article><p>" + "main " * 25 + "</p></article><div class='sidebar-left'><p>" + "side " * 40 + "</p></div><div role=contentinfo>legal words here</div></div>", [("main " * 25).strip()]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_outside_the_table(name):
    page, blocks = PAGES[name]
    assert he.main_text(page, TREE).split("\n\n") == blocks


def test_character_references():
    assert [t for t, _ in he.text_blocks("<p>a&nbsp;b &#233;&#x41; &lt;p&gt; &am &amp &bogus; &amp;amp;</p>")] == ["a b éA <p> &am & &bogus; &amp;"]


def test_given_pages_hold_their_articles(spark):
    """Against a plain reading of the article element: the tree is not told where it is."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from chronospan.llm.queries import op13_html_blocks

    plain = {}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", he.html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        plain[r["page_id"]] = "\n\n".join(p for p in parts if p)
    got = {r["page_id"]: r["text"] for r in op13_html_blocks(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain


def test_edges(spark):
    texts = [None, "", "<p", "no tags at all", "<" * 2000, "<article><p>" + "x " * 400_000 + "</p></article>", "</p></div></article>", "<p>\x00�</p>", "<article>" + "<div>" * 3000 + "<p>deep down there is text of some words</p>"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "page_id long, html string, TEXT string").selectExpr("*", "1 as _html", "2 as words")
    got = {r["page_id"]: r for r in he.extract(df, TREE).collect()}
    assert len(got) == len(texts) and set(he.extract(df, TREE).columns) == {"page_id", "TEXT", "_html", "words", "text_"}
    assert got[0]["text_"] == got[1]["text_"] == got[6]["text_"] == "" and len(got[5]["text_"]) == 799_999 and got[8]["text_"].startswith("deep")
    assert he.extract(df.where("false"), TREE).count() == 0
    again = he.extract(spark.createDataFrame([(1, "<article><p>a b</p></article>")] * 3, "page_id long, html string"), TREE, keep_html=True)
    assert [r["text"] for r in again.collect()] == ["a b"] * 3 and again.columns == ["page_id", "html", "text"]

import itertools
import math

import numpy as np
import pytest

from curaspark.llm import htmlpages, htmltext


@pytest.fixture(scope="module")
def model():
    return htmltext.train(pages=500, epochs=8)


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        parent = [-1, *(int(rng.integers(k)) for k in range(1, n))]
        unary = rng.normal(0, 2, n).tolist()
        edge = [tuple(rng.normal(0, 1.5, 4)) for _ in range(n)]
        p, joint = htmltext.marginals(parent, unary, edge)
        total, one, both = 0.0, np.zeros(n), np.zeros((n, 4))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(u for u, v in zip(unary, y, strict=True) if v) + sum(edge[k][2 * y[parent[k]] + y[k]] for k in range(1, n)))
            total += w
            one += w * np.array(y)
            for k in range(1, n):
                both[k, 2 * y[parent[k]] + y[k]] += w
        assert p == pytest.approx(one / total)
        assert np.array(joint)[1:] == pytest.approx(both[1:] / total)


def test_held_out_layouts(model):
    wrong = blocks = 0
    for k in range(150):
        t = htmltext.parse(htmlpages.labelled_page(5_000_000 + k), labels=True)
        found = htmltext.pieces(t)
        p = model.shown(t, found)
        blocks += len(found)
        wrong += sum((p[n] >= 0.5) != (t.label[n] == 1) for n, _, _ in found)
    assert wrong / blocks < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad --><div class="ad">Buy it now.</div>
<article><h1>A &amp; B&nbsp;&#233;</h1><p><b>First   line<br>goes
on.<br><p>Second <a href="/x">one</a> &lt;here&gt;.</p><script>x("<p>no</p>")</script><p>Third, it ends here.</article>
<div class="comments"><p>I like this very much, a comment.</p></div><footer>&copy; someone</footer></body></html>"""


def test_page(model):
    assert model.text(PAGE) == "A & B é\nFirst line goes on.\nSecond one <here>.\nThird, it ends here."


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "<script>x", "</div></p>", "<div " * 50, "&#0; &bogus; &", "<a><b><i>", "<p>" * 3000, "<div>" * 5000])
def test_broken_pages_do_not_crash(page, model):
    assert isinstance(model.text(page), str)


#: Pages of layouts that the training generator doesn't write, and their articles.
LAYOUTS = [
    (
        """<html><body><div class="topbar"><a href="/">Home</a> <a href="/news">News</a> <a href="/shop">Shop</a></div>
        <table width="100%"><tr><td class="menu"><ul><li><a href="/1">Politics</a><li><a href="/2">Science</a></ul></td>
        <td><h2>Rivers rise in spring</h2><p>The snow of the mountains melts in April, and the rivers carry it to the plain.</p>
        <p>Farmers wait for that water, as it feeds their fields until the summer comes.</p></td></tr></table>
        <div id="footer">Copyright 2020, all rights reserved. <a href="/legal">Legal</a></div></body></html>""",
        ["Rivers rise in spring", "The snow of the mountains melts in April, and the rivers carry it to the plain.", "Farmers wait for that water, as it feeds their fields until the summer comes."],
    ),
    (
        """<!doctype html><body><header><h1><a href="/">The Daily</a></h1></header><main><article><header><h1>A small bridge</h1></header>
        <section><p>Nobody remembers who built the bridge, but everyone in the village has crossed it.</p></section>
        <section><blockquote>It will outlive us, said the miller.</blockquote><p>He was right about that, as about much else.</p></section></article></main>
        <aside class="related"><h3>Read also</h3><ul><li><a href="/a">Ten roads</a></li></ul></aside><form><input name="q"><button>Search</button></form></body>""",
        # known weakness: an article cut in sections of one paragraph each
        ["A small bridge", "Nobody remembers who built the bridge, but everyone in the village has crossed it.", "It will outlive us, said the miller.", "He was right about that, as about much else."],
    ),
]


@pytest.mark.parametrize("page,article", [LAYOUTS[0], pytest.param(*LAYOUTS[1], marks=pytest.mark.xfail(reason="sections of one paragraph are taken for asides", strict=True))])
def test_layouts_of_another_hand(page, article):
    """Most of an article is found and no menu, form or footer, on pages that nothing was trained on."""
    found = htmltext.fitted().text(page).split("\n")
    assert len(set(found) & set(article)) >= 0.75 * len(article) and len(set(found) - set(article)) <= 1


def test_deep_and_broken_pages_take_time_in_proportion():
    import time

    def cost(page):
        began = time.process_time()
        htmltext.parse(page)
        return time.process_time() - began

    cost("<div>" * 1000)
    for page in ("<div>", "<p><b>", "<table><tr><td>", "<ul><li>", "<div></p></li></td>", "<b><i></b>"):
        small, large = (min(cost(page * n) for _ in range(2)) for n in (20_000 // len(page), 1_000_000 // len(page)))
        assert large < 100 * max(small, 0.01), page
        assert large < 6, page  # seconds of a slow machine for a megabyte


def test_long_page_is_read_whole(model):
    paragraphs = [f"Paragraph number {k} has some more words, as all of them do." for k in range(20_000)]
    text = model.text("<html><body><nav><a href='/'>x</a></nav><article><h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body></html>")
    assert text.split("\n") == ["Title of it", *paragraphs]


def test_table(spark, model):
    rows = [(1, "u", PAGE, "c"), (None, None, None, "c"), (2, "v", "", "c"), (1, "u", PAGE, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extracted(df, model).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 67), (None, None, 0), (2, "v", 0), (1, "u", 67)]
    assert got[2].text == "" and got[0].text == got[3].text == model.text(PAGE)
    assert htmltext.extracted(df.limit(0), model).collect() == []

import random

import numpy as np
import pytest

from tidemark.llm import gbt, html_text
from tidemark.llm.dom import Page

BLOCKS = [html_text.FILLER, "Short title", "Home", "Another sentence of the page, with a comma. And one more.", "Contact us today"]


@pytest.fixture(scope="module")
def model():
    return html_text.train(BLOCKS, designs=500)


def read(model, source):
    page = Page(source)
    return page.main_text(page.decode(model.log_odds(np.array(page.features()))))


def test_held_out_designs(model):
    rnd, same = random.Random(77), 0
    for _ in range(150):
        source = html_text.designed(BLOCKS, rnd)
        page = Page(source.replace(" data-main", ""))
        same += page.main_text([bool(x) for x in html_text._marks(source)]) == read(model, source.replace(" data-main", ""))
    assert same >= 0.9 * 150


def test_page_with_all_parts(model):
    source = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>The title</h1><p>First   paragraph, with <b>bold</b> &amp; more &lt;x&gt;.<p>Second
    paragraph.<div class="advert">Buy</div></article><section id="comments"><p>Nice!</p></section><aside><p>Related</p></aside><form><label>Mail</label><input></form>
    <footer>&copy; me</footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert read(model, source) == "The title\nFirst paragraph, with bold & more <x>.\nSecond paragraph."


@pytest.mark.parametrize("inside, want", [
    ("First line of verse<br>Second<br/>third", "First line of verse Second third"), ("<div>It is here<hr>second part</div>", "It is here\nsecond part"),
    ("One<p></p>two<div></div>three", "One\ntwo\nthree"), ("a &amp; b &am<b>p;</b> c &lt;p&gt;", "a & b &amp; c <p>"), ("x&nbsp;y<b>z</b> w", "x yz w")])
def test_breaks_blocks_and_references(inside, want):
    page = Page(f"<html><body><article>{inside}</article></body></html>")
    assert page.main_text([True] * len(page.tag)) == want


def test_reader_is_linear_in_open_elements():
    import time

    def seconds(n):
        began = time.process_time()
        Page("<span>" * n + "<li>x" * n + "<td>y" * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.01)


def test_decoding_has_no_kept_child_below_a_dropped_parent():
    rnd = random.Random(8)
    for _ in range(50):
        page = Page(html_text.designed(BLOCKS, rnd))
        odds = np.array([rnd.gauss(0, 2) for _ in page.tag])
        keep = page.decode(odds)
        assert all(keep[p] or not keep[e] for e, p in enumerate(page.parent) if p >= 0)


def test_awkward_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", "<p>never closed <b>bold"), (5, "u", "<" * 5000), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10),
            (None, None, '<a href="x>y</a><p>odd "quotes'), (7, "u", "<p>" + "word " * 60_000 + "</p>"), (7, "u", "<p>" + "word " * 60_000 + "</p>"), (8, "u", "<script>never closed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html AS text", "page_id AS n_chars")
    got = html_text.extract(df, model=model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == "" and by[2].n_chars == 0 and by[8].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0), designs=20).count() == 0


def test_trees_fit_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    forest = gbt.fit(x[:3000], y[:3000], trees=40, depth=3)
    assert ((forest.log_odds(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.97

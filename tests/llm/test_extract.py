"""The block labeller: held-out accuracy, parsing, and whole pages."""

from __future__ import annotations

import numpy as np
import pytest

from heddle.llm import extract
from heddle.llm.blocks import Pages, blocks_of


@pytest.fixture(scope="module")
def model():
    return extract.train()


def test_blocks():
    page = '<title>t</title><body class=x><p>One &amp; <b>two</b><br>three<p>4 &lt;5<!-- no --><ul><li>a<li><a href="#">b</a></ul><script>if(a<b){"</p>"}</script><div style="display:none">h</div>tail'
    got = blocks_of(page)
    assert [b.text for b in got] == ["One & two three", "4 <5", "a", "b", "h", "tail"]
    assert got[0].path == ("body.x", "p") and got[3].linked == 1.0 and "hidden" in got[4].path[-1]
    assert blocks_of("") == [] and blocks_of("<p") == [] and blocks_of("a <b") and blocks_of("<script>x") == []


def test_gradients_are_the_slopes():
    r = np.random.default_rng(1)
    model = extract.Labeller(3)
    model.p = [p.astype(np.float64) for p in model.p]
    rows = [r.standard_normal((n, model.p[0].shape[0])).astype(np.float32) for n in (3, 5)]
    labels = [np.array([1, 0, 1.0]), np.array([0, 0, 1, 1, 0.0])]

    def loss():
        z, y = np.concatenate(model.scores(rows)), np.concatenate(labels)
        return float((np.logaddexp(0, z) - y * z).mean())

    for p, g in zip(model.p, model.gradients(rows, labels), strict=True):
        at = tuple(r.integers(0, n) for n in p.shape)
        old, eps = p[at], 1e-3
        p[at] = old + eps
        high = loss()
        p[at] = old - eps
        low = loss()
        p[at] = old
        assert abs((high - low) / (2 * eps) - g[at]) < 2e-3


def test_held_out_accuracy(model):
    source, right, total = Pages(12345), 0, 0
    for _ in range(200):
        x, y = extract.labelled(source.page())
        right += int(((model.scores([x])[0] > 0) == y.astype(bool)).sum())
        total += len(y)
    assert right / total > 0.99


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>A  headline</h1><p>First paragraph, with &eacute; and\n a <a href="#">link</a> in it.</p><div class="ad">Buy now!</div><p>Second paragraph of the story.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice story, thanks.</p></div></section><form><label>Email</label><input></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text(model):
    assert extract.main_texts([PAGE, None, ""], model) == [
        "A headline\n\nFirst paragraph, with é and a link in it.\n\nSecond paragraph of the story.", "", "",
    ]


def test_extract(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    rows = sorted(tuple(r) for r in extract.extract(df).select("page_id", "n_chars").collect())
    assert rows[2] == (2, 0) and rows[0] == rows[1] and rows[0][1] > 50
    assert extract.extract(df.limit(0)).isEmpty()


def test_long_attributes_and_foreign_elements():
    long = "<p data-x='" + "y>" * 3000 + "'>One <math><mi>e</mi></math> two <svg><text>three</text></svg></p><p title=\"open>four</p>"
    assert [b.text for b in blocks_of(long)] == ["One e two three", "four"]


def test_long_pages_in_stretches(model, monkeypatch):
    blocks = blocks_of(PAGE) * 7
    whole = model.scores([extract.features(blocks)])[0]
    monkeypatch.setattr(extract, "STRETCH", 5)
    assert np.abs(model.long_scores(blocks) - whole).max() < 1e-4
    want = extract.main_texts([PAGE, PAGE * 3, None], model)
    monkeypatch.setattr(extract, "CELLS", 8)
    assert extract.main_texts([PAGE, PAGE * 3, None], model) == want


def test_a_page_of_many_blocks_needs_little_memory(model):
    import tracemalloc

    tracemalloc.start()
    blocks = blocks_of("<p>a b</p>" * 50_000)
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    assert len(model.long_scores(blocks)) == 50_000
    assert tracemalloc.get_traced_memory()[1] - before < 60 << 20
    tracemalloc.stop()

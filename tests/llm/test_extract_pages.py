"""Word recall and precision of the extractor on the given pages and on pages labelled by hand."""

from __future__ import annotations

from collections import Counter

import pyarrow.parquet as pq
import pytest

from heddle.llm import extract
from heddle.llm.blocks import blocks_of
from tests.llm.labelled_pages import PAGES, UNSEEN


@pytest.fixture(scope="module")
def model():
    return extract.train()


def shares(found, wanted):
    """(recall, precision) of words over all pages."""
    both = all_found = all_wanted = 0
    for f, w in zip(found, wanted, strict=True):
        f, w = Counter(f.split()), Counter(w.split())
        both, all_found, all_wanted = both + (f & w).total(), all_found + f.total(), all_wanted + w.total()
    return both / all_wanted, both / all_found


@pytest.mark.parametrize("pages", [PAGES, UNSEEN])
def test_pages_labelled_by_hand(model, pages):
    recall, precision = shares(extract.main_texts([h for h, _ in pages.values()], model), [" ".join(t) for _, t in pages.values()])
    assert recall > 0.97 and precision > 0.93


def test_given_pages(model):
    """The given pages have one layout, in which the main text is what stands in the article element."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    wanted = [" ".join(b.text for b in blocks_of(h) if any(p.startswith("article") for p in b.path)) for h in pages]
    recall, precision = shares(extract.main_texts(pages, model), wanted)
    assert recall > 0.995 and precision > 0.995

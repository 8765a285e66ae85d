"""Packing: every token once, no overlap, no gaps, as few sequences as best fit decreasing needs."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from heddle.llm import bestfit
from heddle.llm.queries import vocabulary


def one_by_one(sizes, capacity):
    """Sequences that best fit takes, longest piece first."""
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        if at == len(gaps):
            n += 1
            left = capacity - s
        else:
            left = gaps.pop(at) - s
        if left:
            bisect.insort(gaps, left)
    return n


def packed(rows, capacity):
    """Sequences of (sequence, offset, length) rows, none of which overlap, overflow or leave a gap between."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_sequences_as_best_fit_decreasing(spark, seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    sizes = [r.choice([r.randint(1, capacity), r.randint(1, max(1, capacity // 8)), capacity // 3, 1]) for _ in range(3000)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "id long, length long").repartition(7)
    got = bestfit.best_fit(df, "length", capacity).collect()
    assert sorted((r["id"], r["length"]) for r in got) == list(enumerate(sizes))
    assert packed([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity) == one_by_one(sizes, capacity)


def test_wrong_sizes_and_nothing(spark):
    df = spark.createDataFrame([(1, 0)], "id long, length long")
    for bad in (df, df.withColumn("length", df["id"] + 64)):
        with pytest.raises(Exception, match="sizes are 1 to 64"):
            bestfit.best_fit(bad, "length", 64).collect()
    assert bestfit.best_fit(df.limit(0)).isEmpty()


def test_documents(spark):
    path, r = vocabulary("byte_bpe_50k.json"), random.Random(2)
    words = ["the", "of", "étude", "Zq", "x" * 30, "<|endoftext|>", " ", "don't", "\t", "  ", "99", "中文"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 400])))) for k in range(120)] + [(3, None), (None, ""), (3, "same"), (3, "same"), (500, "long text " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as length", "1 as sequence_id")
    library = Tokenizer.from_file(path)
    got = bestfit.pack_documents(df.repartition(3), path, 64, with_ids=True).collect()
    packed([(x["sequence_id"], x["offset"], x["length"]) for x in got], 64)
    want = []
    for k, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        if len(ids) <= 64:
            cuts = [0, len(ids)]
        want += [(k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4")), ids[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(repr, want)) == sorted(repr((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], x["ids"])) for x in got)
    plain = bestfit.pack_documents(df, path, 2048)
    assert plain.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert bestfit.pack_documents(df.limit(0), path).isEmpty()


def test_ids_fuzz():
    path = vocabulary("byte_bpe_50k.json")
    own, library, r = bestfit.Ids(path), Tokenizer.from_file(path), random.Random(9)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'LL", "é", "²", "½", "_", "1", "٣", "<|endoftext|>", "<|", "中", "\xa0", " ", "\x1c", "\x85", "😀", "Σ", "İ", "!!", "\r\n", "aaaa", "0" * 50, "\x0b", "\x00", "Ǆ", "…", "–"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert own.of(text) == library.encode(text, add_special_tokens=False).ids, text

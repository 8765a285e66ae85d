"""Near copies against all pairs in plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from heddle.llm import nearcopies
from tests.llm import brute


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{r.random()}"
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(25):
        words = [word() for _ in range(r.randint(20, 400))]
        texts += [" ".join(edited(r, words, min(len(words), k))) for k in (0, 0, 1, 2, 4, 8)]
    chain = [word() for _ in range(200)]
    for _ in range(30):
        texts.append(" ".join(chain))
        chain = chain[9:] + [word() for _ in range(9)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("block", "block_bytes"), [(nearcopies.BLOCK, nearcopies.BLOCK_BYTES), (3, 5000), (nearcopies.BLOCK, 300)])
def test_near_copies(spark, rows, block, block_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearcopies.keep_one(docs, block=block, block_bytes=block_bytes)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == brute.near_survivors(rows)
    assert nearcopies.keep_one(docs.limit(0)).isEmpty()


def test_planted_pairs_just_over_the_limit_are_caught(spark):
    """1,000 pairs with a similarity of 0.80 to 0.85, changed in one place or in several: all are caught."""
    r, rows, pairs = random.Random(12), [], 1000
    while len(rows) < 2 * pairs:
        words = [f"w{r.randrange(10**7)}" for _ in range(300)]
        other = list(words)
        for at in r.sample(range(0, 290, 10), r.choice([1, 2, 4])):
            size = 6 if len(rows) % 3 else 1
            other[at : at + size] = [f"n{r.randrange(10**7)}" for _ in range(size)]
        first = r.randint(0, 24)
        other[:first] = [f"m{r.randrange(10**7)}" for _ in range(first)]
        one, two = (brute.word_shingles(" ".join(x)) for x in (words, other))
        if 0.80 <= len(one & two) / len(one | two) <= 0.85:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 2 * pairs, 2))


def test_pipeline_stage_drops_a_near_copy_and_keeps_one_of_repeated_rows(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    near, other, third = " ".join(edited(r, words, 5)), " ".join(f"o{k}" for k in range(90)), " ".join(f"t{k}" for k in range(90))
    rows = [(1, " ".join(words)), (2, near), (3, other), (3, other), (None, third), (None, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_chains_admit_all_pairs_within_the_radius():
    r = np.random.default_rng(4)
    one = r.integers(0, 1 << 64, nearcopies.WORDS, np.uint64)
    others = np.repeat(one[None, :], 400, 0)
    for row in others:
        for bit in r.choice(256, r.integers(0, 65), False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    assert nearcopies.near(one, others, nearcopies.RADIUS).all()
    assert not nearcopies.near(one, r.integers(0, 1 << 64, (400, nearcopies.WORDS), np.uint64), nearcopies.RADIUS).any()


def test_similar_sets_lie_within_the_radius():
    r = np.random.default_rng(5)
    for size in (60, 300, 2000):
        for _ in range(60):
            base = r.integers(0, 1 << 64, size, np.uint64)
            other = base.copy()
            other[: size // 9] = r.integers(0, 1 << 64, size // 9, np.uint64)  # similarity 0.8
            assert nearcopies.near(nearcopies.wide_print(base), nearcopies.wide_print(other)[None], nearcopies.RADIUS)[0]


def test_sets_travel_as_texts_and_link_as_before(spark, monkeypatch):
    """No table between the steps holds hashes of whole texts, which take over twice the room of the texts."""
    kinds, write = {}, nearcopies.materialise
    monkeypatch.setattr(nearcopies, "materialise", lambda df, label, **more: kinds.setdefault(label, dict(df.dtypes)) and write(df, label, **more))
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*words[: 98 - k], "x", *words[99 - k :]])) for k in range(8)] + [(20, " ".join(words[::-1])), (21, None), (22, "")]
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(row["doc_id"] for row in got.collect()) == [0, 20, 21]
    assert kinds["near-sets"]["_text"] == kinds["near-asked"]["_text"] == "string"
    assert not any(kind == "binary" for table in kinds.values() for kind in table.values())


def test_kept_rows_are_not_sent(spark):
    """The result's plan moves tags and bitmaps, never a text, also where no table is small enough to be broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = nearcopies.keep_one(spark.createDataFrame([(k, f"text {k // 2}") for k in range(40)], "doc_id long, text string").repartition(3))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(row["doc_id"] for row in got.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

"""Which documents the robust estimates of the quality rules reach."""

from __future__ import annotations

import random

from heddle.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def clean(r, n):
    return [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200))) for _ in range(n)]


def junk(r):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) + "$$%%" for _ in range(80))


def kept(spark, rows):
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], SCHEMA)
    return {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}


def test_small_groups_are_judged_with_their_language_and_the_table(spark):
    r = random.Random(5)
    rows = [(t, "en", "large") for t in clean(r, 80)] + [(t, "en", "small") for t in clean(r, 10)] + [(t, "fr", None) for t in clean(r, 10)]
    rows += [(junk(r), "en", "large"), (junk(r), "en", "small"), (junk(r), "fr", None), (junk(r), None, "new")]
    got = kept(spark, rows)
    assert all(got[k] for k in range(100)) and not any(got[k] for k in range(100, 104))


def test_lines_or_repeats_alone_reject(spark):
    r = random.Random(6)
    rows = [(t, "en", "s") for t in clean(r, 120)]
    lines = "\n".join(["ab"] * 41 + [f"x{k}" for k in range(8)] + [clean(r, 1)[0]])  # 80 % of the lines repeat one
    words = clean(r, 1)[0].split()[:60]
    repeats = " ".join(words[:20] + words[:20] + [w[::-1] + "k" for w in words] + clean(r, 1)[0].split()[:10])  # 36 % of the words
    got = kept(spark, [*rows, (lines, "en", "s"), (repeats, "en", "s")])
    assert all(got[k] for k in range(120)) and not got[120] and not got[121]


def test_copies_of_a_third_of_a_group_are_rejected(spark):
    r = random.Random(7)
    rows = [(t, "en", "s") for t in clean(r, 200)]
    copy = " ".join(w + "$%" for w in clean(r, 1)[0].split())
    got = kept(spark, rows + [(copy, "en", "s")] * 100)
    assert all(got[k] for k in range(200)) and not any(got[k] for k in range(200, 300))

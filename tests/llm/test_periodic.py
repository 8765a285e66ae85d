"""Periodic runs against a search of every stretch."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from heddle.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            end = k
            while end + q < n and w[end] == w[end + q]:
                end += 1
            size = end - k + q
            part = w[k : k + size]
            if end > k and size >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((k, size, q))
            k = max(end, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(key, text):
    w = WORD.findall(text or "")
    if key is not None and w:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            n, a = len(w), g % len(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *most, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def texts(r, n):
    out = [None, "", "  \n", "a", "a " * 6, "a " * 5, "a b " * 4, "a b " * 3 + "a", "a a b " * 9, "ab ab " * 8, "x\x0by\x0cx\ry " * 5, "é ü " * 7 + "é"]
    for _ in range(n):
        w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randint(0, 70))]
        for _ in range(r.randint(0, 2)):
            p, at = r.randint(1, 9), r.randint(0, len(w))
            w[at:at] = [r.choice("abcde") for _ in range(p)] * r.randint(2, 7)
        out.append(r.choice(["", " ", "\n"]) + "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w))
    return out


@pytest.mark.parametrize("lags", [1, 4, 1 << 20])
def test_against_a_search(spark, lags):
    rows = list(enumerate(texts(random.Random(3), 250))) + [(3, "a " * 9), (3, "a " * 9), (None, "b c " * 9)]
    rows.append((9001, " ".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(4000)) + " q r" * 30))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = periodic.run_digests(df, lags=lags).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((k, *expected(k, t))) for k, t in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 50


def test_runs_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "x  a b a b a b\na b y", "clash"), (2, None, "")], "doc_id long, text string, _text string")
    got = {r["doc_id"]: r for r in periodic.find_runs(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)] and got[1]["collapsed"] == "x a b y" and got[1]["n_words"] == 10
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["n_words"] == 0
    assert periodic.run_digests(df.limit(0)).isEmpty()

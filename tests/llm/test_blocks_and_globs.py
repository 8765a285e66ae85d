"""Benchmark items that are longer than a block, and globs that keep to the host or the path."""

from __future__ import annotations

import random

from heddle.llm import decontaminate, urlfilter
from tests.llm import brute


def test_items_longer_than_a_block(spark):
    r = random.Random(11)
    words = [f"w{r.randint(0, 400)}" for _ in range(3000)]
    items = [(1, " ".join(words)), (2, "short item here"), (3, " ".join(words[500:540])), (4, "x" * 5000 + " " + " ".join(f"y{k}" for k in range(20)))]
    rows = [(k, " ".join(words[at : at + n])) for k, (at, n) in enumerate((r.randint(0, 2980), r.randint(1, 40)) for _ in range(80))]
    rows += [(100, "a short item here b"), (101, None), (102, items[3][1]), (103, " ".join(words[::-1])), (104, " ".join(words))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(rows, items))
    assert sum(w[-1] for w in want) > 40
    for block_bytes in (1 << 22, 20_000, 2_000):
        assert sorted(tuple(x) for x in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()) == want


def test_a_block_holds_what_its_size_allows(spark):
    items = [(str(k), " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate([3, 2000, 10, 11, 900, 1, 50])]
    packed = decontaminate._in_blocks(spark.createDataFrame(items, "name string, text string"), 10, 1000).collect()
    sizes = {}
    for row in packed:
        sizes[row["block"]] = sizes.get(row["block"], 0) + len(row["text"])
    assert max(sizes.values()) <= 1250 and len(sizes) > 10


def test_globs_keep_to_host_or_path(spark):
    urls = ["http://a.example/x", "http://a.example", "http://b.example/a.example/x", "http://free-bets.example/", "http://alphabets.example/", "http://x.adult-y.example/z", "http://n.example/adult"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = lambda globs: [r["verdict"] for r in urlfilter.filter_urls(df, rules=(), globs=globs).orderBy("page_id").collect()]
    assert judged([("block", "a.example")]) == ["block", "block"] + ["allow"] * 5
    assert judged([("block", "*.example/x")]) == ["block"] + ["allow"] * 6
    assert judged([("block", "*/a*")]) == ["allow", "allow", "block", "allow", "allow", "allow", "block"]
    assert judged(urlfilter.GLOBS) == ["allow", "allow", "allow", "block", "allow", "block", "allow"]


def test_urls_repeated_and_with_other_columns(spark):
    df = spark.createDataFrame([(1, "http://x.net/es/", "a", 1)] * 3 + [(None, None, "b", 2)], "page_id long, url string, host string, _k int")
    got = urlfilter.filter_urls(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "x.net", "/es/", "net/es/", "block")] * 3 + [(None, "", "", None, "allow")]))

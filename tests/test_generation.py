"""Replies, retries and self-correction with clients of our own; probes read back; blocks of an order."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.operators import blocks, correct, estimates, filtering, memory, nearest, probes, tokenizer
from heddle.sources import hub, teacher


def test_patience():
    waits, left = [], [2]

    def ask(prompt, system):
        if left[0]:
            left[0] -= 1
            raise teacher.Busy("429")
        return prompt + system

    assert teacher.patiently(ask, "p", "s", sleep=waits.append) == "ps"
    assert len(waits) == 2 and 2.5 <= waits[0] <= 4 and 4.5 <= waits[1] <= 6
    left[0] = 9
    with pytest.raises(TimeoutError):
        teacher.patiently(ask, "p", "s", attempts=3, sleep=waits.append)

    def broken(prompt, system):
        raise RuntimeError("HTTP 400")

    with pytest.raises(RuntimeError):
        teacher.patiently(broken, "p", "s")


def reply(prompt, system):
    """Broken code at first for tasks that say so; whole code once the error is fed back."""
    if "never" in prompt or ("later" in prompt and "produced the following error" not in prompt):
        return "<code>def f(:</code>"
    return "<think>x</think><code>\ndef f():\n    return 1\n</code>"


def test_self_correction(spark):
    tasks = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never"), (4, "never later")], "id int, prompt string")
    ask = lambda df, prompt, out: teacher.replies(df, prompt, reply, reply=out)
    got = {r["id"]: r for r in correct.self_correct(tasks, "prompt", ask, "python", rounds=3).collect()}
    assert {k: r["attempts"] for k, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert got[1]["code"] == "def f():\n    return 1" and got[2]["verified"] and got[2]["error"] is None
    assert not got[3]["verified"] and "SyntaxError" in got[3]["error"] and got[3]["checker"] == "ast"
    assert correct.self_correct(tasks.limit(0), "prompt", ask, "python").isEmpty()


def test_probes_read_back(spark, tmp_path):
    r = random.Random(1)
    rows = [([r.gauss(3 * (k % 2), 1) for _ in range(4)], "ab"[k % 2], float(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "embedding array<double>, name string, y double")
    one = probes.ClassificationProbe(["a", "b"]).fit(df, "embedding", "name")
    one.save(str(tmp_path / "c"))
    two = probes.ClassificationProbe.load(str(tmp_path / "c"))
    assert two.labels == ["a", "b"] and two.predict(df, "embedding").collect() == one.predict(df, "embedding").collect()
    three = probes.RegressionProbe().fit(df, "embedding", "y")
    three.save(str(tmp_path / "r"))
    assert probes.RegressionProbe.load(str(tmp_path / "r")).predict(df, "embedding").collect() == three.predict(df, "embedding").collect()


def test_token_budget():
    got = estimates.token_budget(1000, 20.0, 2, 4, 8)
    assert got == {"tokens_per_step": 64, "target_tokens": 20000, "steps": 313, "regime": "chinchilla-optimal"}
    assert estimates.token_budget(10, 31.0, 1, 1, 1, 5)["regime"] == "overtraining"


@pytest.mark.parametrize("kind", ["string", "timestamp", "int", "double", "binary", "boolean", "decimal(9,2)", "date"])
@pytest.mark.parametrize("rows_a_block", [20_000, 30])
def test_running_sums_of_any_order(spark, monkeypatch, kind, rows_a_block):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows_a_block)
    r = random.Random(3)
    rows = [(r.choice([None, *range(40)]), k, r.randint(0, 5)) for k in range(900)]
    df = spark.createDataFrame(rows, "a int, k int, n int")
    made = F.date_add(F.lit("2020-01-01").cast("date"), F.col("a")) if kind == "date" else F.concat(F.lit("it's \\ "), F.col("a")) if kind == "string" else F.col("a").cast("long").cast("string").cast(kind) if kind == "binary" else F.col("a").cast("long").cast(kind)
    df = df.withColumn("a", made).repartition(5)
    got = blocks.running_before(df, F.col("n"), [F.col("a"), F.struct(F.col("k").alias("x"))], "before").orderBy("a", "k").collect()
    total = 0
    for row in got:
        assert row["before"] == total
        total += row["n"]
    assert len(got) == 900 and blocks.running_before(df.limit(0), F.col("n"), [F.col("a")], "before").isEmpty()


def test_limits_and_dedup_with_one_large_group(spark):
    df = spark.range(5000).select(F.lit("x").alias("g"), F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("same")).alias("t")).repartition(7)
    assert [r["id"] for r in filtering.limit_per_group(df, "g", 30, ["id"]).orderBy("id").collect()] == list(range(30))
    kept = filtering.exact_dedup(df, "t", ["id"])
    assert kept.where("t is not null").select("id").collect()[0][0] == 1 and kept.where("t is null").count() == 1667


def test_search_of_many_queries(spark):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(300)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "idx long, key array<double>").repartition(3)
    queries = df.where("idx % 20 = 0")
    want = {q["idx"]: [h["index"] for h in memory.retrieve(df.where("size(key) = 5").withColumn("text", F.lit("")), q["key"], 4).collect()] for q in queries.collect() if q["key"]}
    for size in (50_000, 40):
        got = {}
        for h in nearest.build(df, slice_rows=size).search(queries, 4).orderBy("query", "rank").collect():
            got.setdefault(h["query"], []).append(h["index"])
        assert got == want


def test_folders():
    assert [hub.folder_of(n) for n in ("javascript", "typescript", "python", "vue", "css", "html", "markdown", "json", "yaml", "scss")] == [
        "JavaScript", "TypeScript", "Python", "Vue", "CSS", "HTML", "Markdown", "JSON", "YAML", "scss",
    ]


def test_texts_are_encoded_in_bounded_parts(spark, monkeypatch):
    from public_tokenizers import path

    file, most = path("byte_bpe_50k.json"), []
    own = tokenizer._load(file)

    class Watched:
        def encode_batch(self, texts, add_special_tokens):
            most.append(sum(map(len, texts)))
            return own.encode_batch(texts, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(tokenizer, "TOGETHER", 1000)
    r = random.Random(3)
    texts = [None, "", *("ab é \U0001f600\n" * r.randint(0, 60) for _ in range(200)), "x" * 5000, None, "end"]
    found = pd.concat(list(tokenizer.encoded(Watched(), pd.Series(texts))))
    want = [None if t is None else own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [None if x is None else x.tolist() for x in found] == want
    assert len(most) > 50 and sorted(most)[-2] <= 1000 and max(most) == 5000
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    ids = df.select("k", "t", tokenizer.encode("t", file).alias("ids"))
    got = {x["k"]: x for x in ids.select("k", "t", "ids", tokenizer.decode("ids", file, skip_special=False).alias("back")).collect()}
    assert [got[k]["ids"] for k in range(len(texts))] == want and [got[k]["back"] for k in range(len(texts))] == texts

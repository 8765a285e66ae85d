"""External checkers with tools of our own, replies that outlive a lost task, hashes of earlier runs, streams of ids, counters."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import checkers
from heddle.operators import filtering, seen
from heddle.plans import pipeline
from heddle.sources import teacher, tokenbin


def tool(folder, name, script):
    file = folder / name
    file.write_text(f"#!/bin/sh\n{script}\n")
    file.chmod(0o755)


@pytest.fixture
def tools(tmp_path):
    return tmp_path


def test_tools_decide(spark, tools):
    tool(tools, "mypy", 'for f; do :; done\nif /bin/grep -q wrong "$f"; then echo "bad type"; exit 1; fi')
    tool(tools, "node", 'if /bin/grep -q slow "$2"; then /bin/sleep 30; fi\nif /bin/grep -q wrong "$2"; then echo "no" >&2; exit 1; fi')
    tool(tools, "tsc", 'for f; do :; done\n/bin/grep -q wrong "$f" && exit 2 || exit 0')
    code = [
        (0, "x = 1", "python"), (1, "wrong = 1", "py"), (2, "def f(:", "py"), (3, "let a = 1", "js"), (4, "wrong()", "javascript"), (5, "slow()", "js"),
        (6, "f(", "js"), (7, "let a: number", "ts"), (8, "wrong", "ts"), (9, " ", "ts"), (10, "x", "cobol"), (11, None, "py"),
    ]
    df = spark.createDataFrame(code, "k int, code string, lang string").coalesce(1)
    began = time.time()
    got = {r["k"]: tuple(r["x"]) for r in df.select("k", checkers.verify_with_tools("code", "lang", timeout=1, path=str(tools)).alias("x")).collect()}
    assert time.time() - began < 25  # the one that hangs is killed
    assert got[0] == (True, True, False, None, "mypy") and got[1] == (False, True, False, "bad type", "mypy")
    assert got[2][4] == "ast" and not got[2][0] and got[2][1]
    assert got[3] == (True, True, False, None, "node") and got[4] == (False, False, False, "no", "node")
    assert got[5] == (False, False, False, "node --check timed out after 1s", "node")
    assert got[6][2] and got[6][4] == "heuristic" and got[7] == (True, True, False, None, "tsc") and got[8] == (False, False, False, "", "tsc")
    assert got[9][3] == "Empty TypeScript code snippet." and "Unsupported" in got[10][3] and got[11][4] == "none"


def test_absent_tools_leave_a_heuristic(tools):
    own = checkers.Checkers(path=str(tools))
    assert own.one("let a", "ts") == (True, False, True, None, "heuristic") and own.one("a = 1", "py") == (True, True, False, None, "ast")
    tool(tools, "eslint", "exit 1")
    assert own.one("let a", "js")[4] == "heuristic"  # not asked where the other tool is absent
    tool(tools, "node", "exit 0")
    assert own.one("let a", "js") == (False, False, False, "", "eslint")


def test_replies_are_asked_for_once(spark, tmp_path):
    """A task fails half way, and comes again; a second run finds everything."""
    asked, log = tmp_path / "asked", str(tmp_path / "log")
    asked.mkdir()

    def ask(prompt, system):
        with open(asked / prompt.replace(" ", "-"), "a") as f:
            f.write("x")
        return prompt.upper()

    df = spark.createDataFrame([(k, f"task {k}" if k != 5 else None) for k in range(12)], "k int, p string").coalesce(1)
    own = teacher.Log(f"{log}/run-first", teacher.SYSTEM)
    for k in range(4):  # what a lost task has left, its last line cut off
        own.reply(f"task {k}", lambda p: ask(p, ""))
    own.close()
    file = next((tmp_path / "log" / "run-first").iterdir())
    file.write_text(file.read_text()[:-9])
    again = teacher.Log(f"{log}/run-first", teacher.SYSTEM)
    assert set(again.known) == {teacher.key_of(teacher.SYSTEM, f"task {k}") for k in range(3)}
    got = {r["k"]: r["reply"] for r in teacher.replies(df, "p", ask, log=log).collect()}
    assert got == {k: None if k == 5 else f"TASK {k}" for k in range(12)}
    teacher.replies(df, "p", ask, log=log).collect()
    assert {f.name: len(f.read_text()) for f in asked.iterdir()} == {f"task-{k}": 2 if k == 3 else 1 for k in range(12) if k != 5}


def test_a_partition_finds_what_its_lost_attempt_had(tmp_path):
    log = str(tmp_path)
    first = teacher.Log(log, "s")
    first.reply("a", str.upper)
    first.attempt, second = 1, teacher.Log(log, "s")  # the first is gone without a word
    second.attempt = 2
    assert second.reply("a", lambda p: pytest.fail("asked again")) == "A" and second.reply("b", str.upper) == "B"
    second.close()
    assert len(list(tmp_path.iterdir())) == 2


def test_hashes_of_earlier_runs(spark, tmp_path):
    store = seen.Seen(spark, str(tmp_path / "seen"), expected=5000, buckets=8)
    docs = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    assert store.flagged(docs).where("_seen").isEmpty()
    store.add(docs.where("id < 100").unionAll(docs.where("id < 50")), "one")
    store.add(docs.where("id between 90 and 149"), "two")
    store.add(docs.where("id = 2999"), "two")  # the run is there already
    new = docs.unionAll(spark.createDataFrame([(9999, None)], "id long, hash string")).unionAll(docs.where("id = 7"))
    got = store.flagged(new)
    assert sorted(r["id"] for r in got.where("_seen").collect()) == sorted([*range(150), 7]) and got.count() == 3002
    passing = store.passing(docs.select(F.col("hash").alias("_known"))).count()
    assert 150 <= passing < 250  # all that were seen, and few others
    assert store.flagged(docs.where("id > 2000").limit(20)).where("_seen").isEmpty()
    # Few hashes open few buckets of the table. (The plan says so where a scan keeps its buckets.)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    few = [r["hash"] for r in docs.where("id < 2").collect()]
    table = store._table(store._runs("hashes")[0])
    joined = table.where(F.col("_known").isin(few)).join(docs, F.col("_known") == F.col("hash"))
    plan = joined.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 2 out of 8" in plan or "SelectedBucketsCount: 1 out of 8" in plan
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_a_run_that_was_cut_off_counts_for_nothing(spark, tmp_path):
    store = seen.Seen(spark, str(tmp_path / "seen"), expected=100, buckets=2)
    docs = spark.createDataFrame([("a",), ("b",)], "hash string")
    store.add(docs, "one")
    os.remove(tmp_path / "seen" / "run=one" / "filter" / "_SUCCESS")
    assert store.flagged(docs).where("_seen").isEmpty()
    store.add(docs.where("hash = 'a'"), "one")
    assert [r["hash"] for r in store.flagged(docs).where("_seen").collect()] == ["a"]


def test_stream_of_ids(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(k, r.integers(-5, 60_000, r.integers(0, 40)).tolist()) for k in range(400)] + [(400, None), (401, r.integers(0, 9, 30_000).tolist())]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(6)
    want = np.concatenate([np.array(ids or [], "<i4") for _, ids in rows])
    path = tmp_path / "out" / "stream.bin"
    assert tokenbin.write_stream(df, "ids", ["k"], f"file://{path}") == len(want)
    assert path.read_bytes() == want.tobytes() and [f.name for f in path.parent.iterdir()] == ["stream.bin"]
    for window, split in ((128, 4096), (7, 100), (1 << 20, 1 << 20)):
        got = sorted((x["at"], x["ids"]) for x in tokenbin.read_stream(spark, str(path), window, split).collect())
        assert [at for at, _ in got] == list(range(0, len(want), window))
        assert sum((ids for _, ids in got), []) == want.tolist() and all(len(ids) == window for _, ids in got[:-1])
    with pytest.raises(Exception, match="stream.bin"):
        tokenbin.write_stream(df, "ids", ["k"], str(path))
    assert tokenbin.write_stream(df.where("k < 3"), "ids", ["k"], str(path), overwrite=True) == sum(len(x or []) for _, x in rows[:3])
    assert tokenbin.write_stream(df.limit(0), "ids", ["k"], str(tmp_path / "none.bin")) == 0
    assert tokenbin.read_stream(spark, str(tmp_path / "none.bin")).isEmpty()
    with pytest.raises(ValueError, match="mounted"):
        tokenbin._local("hdfs://x/y.bin")


def test_a_stream_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2]), (2, [3])], "at long, ids array<int>")
    spark.dataSource.register(tokenbin.TokenStream)
    with pytest.raises(Exception, match="3 ids written of a stream of 4"):
        df.write.format("tokenstream").option("ids", 4).mode("append").save(str(tmp_path / "s.bin"))
    broken = df.withColumn("at", F.when(F.col("at") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("at")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("tokenstream").option("ids", 3).mode("append").save(str(tmp_path / "s.bin"))
    assert list(tmp_path.iterdir()) == []


def test_counters_are_those_of_the_rows_written(spark, tmp_path):
    good = "# adds two numbers and returns the sum of both\ndef add(a, b):\n    if a:\n        return a + b\n    return b\n" * 2
    (tmp_path / "raw").mkdir()
    docs = [{"content": good, "lang": "python", "license": "mit"}] * 5 + [{"content": good + "#", "lang": "python", "license": "mit"}, {"content": good, "lang": "cobol", "license": "mit"}]
    (tmp_path / "raw" / "a.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n{broken\n")
    stats = pipeline.filter_all(spark, str(tmp_path / "raw"), str(tmp_path / "out")).first().asDict()
    assert (stats["total"], stats["lang_filtered"], stats["dedup_filtered"], stats["accepted"]) == (8, 1, 4, 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_mass_of_copies_is_ranked_in_shares(spark):
    good = "# adds two numbers and returns the sum of both\ndef add(a, b):\n    if a:\n        return a + b\n    return b\n" * 2
    df = spark.range(3000).select("id", F.lit(good).alias("content"), F.lit("python").alias("lang"), F.lit("mit").alias("license"), F.lit("p").alias("path")).repartition(5)
    twice = df.unionAll(df.where("id = 0"))  # rows that even share their place
    flagged = filtering.with_reasons(twice, ["id"])
    assert [r["id"] for r in flagged.where("reason = 'accepted'").collect()] == [0] and flagged.where("reason = 'dedup'").count() == 3000

"""Files in and out, the pipeline over them, streams, and the entry points."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heddle.plans import pipeline
from heddle.plans import queries as core
from heddle.sources import files, hub
from heddle.streaming import incremental

GOOD = "# adds two numbers and returns the sum of both\ndef add(a, b):\n    if a:\n        return a + b\n    return b\n" * 2


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_jsonl(spark, tmp_path):
    write(tmp_path / "b.jsonl", [json.dumps({"content": "é", "lang": "python", "other": 1}), "{broken", "[1]", "", '"text"'])
    write(tmp_path / "a.txt", ["ignored"])
    rows = files.read_jsonl(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and sum(r["malformed"] for r in rows) == 3
    assert [r["content"] for r in rows if not r["malformed"]] == ["é"]


def test_source_tree(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.py").write_text("a = 1\n\nb = 2\n")
    (tmp_path / "x" / "y" / "b.js").write_text("b")
    (tmp_path / "x" / "c.txt").write_text("c")
    (tmp_path / "x" / "d.py").write_text(" \n")
    assert files.read_source_tree(spark, [str(tmp_path / "x"), str(tmp_path / "none")]).count() == 2
    assert files.read_source_tree(spark, [str(tmp_path / "x")], 1).count() == 1
    assert files.read_source_tree(spark, [str(tmp_path / "none")]).isEmpty()


def test_token_files(spark, tmp_path):
    np.arange(5, dtype="<i4").tofile(tmp_path / "a.bin")
    assert [r["ids"] for r in files.read_token_files(spark, str(tmp_path)).collect()] == [[0, 1, 2, 3, 4]]
    docs = spark.createDataFrame([(1, [3, 4]), (0, [1, 2]), (2, None)], "i int, ids array<int>")
    files.write_token_stream(docs, "ids", ["i"], str(tmp_path / "out"))
    parts = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(np.frombuffer(bytes(r["data"]), "<i4").tolist() for r in parts) == [[1, 2], [3, 4]]
    write(tmp_path / "ids.jsonl", ['{"input_ids": [5, 6]}', '{"input_ids": []}'])
    assert [r["input_ids"] for r in files.read_ids_jsonl(spark, str(tmp_path / "ids.jsonl")).collect()] == [[1, 5, 6, 2]]
    with pytest.raises(ValueError):
        files.read_ids_jsonl(spark, "x.parquet")


def test_raw_lines_and_write_once(spark, tmp_path):
    write(tmp_path / "l.jsonl", [" a ", "", "b"])
    lines = files.read_raw_lines(spark, [str(tmp_path / "l.jsonl"), str(tmp_path / "none")])
    assert sorted(r["line"] for r in lines.collect()) == ["a", "b"]
    assert files.write_once(lines, str(tmp_path / "o")) and not files.write_once(lines, str(tmp_path / "o"))
    assert files.random_tokens(spark, 100).agg(F.min("token"), F.max("token")).first()[0] >= 4


def test_hub_projection(spark):
    df = spark.createDataFrame([("a", "python", "r", "p1"), (" ", "python", "r", "p2"), ("b", "python", "r", "p3")], "content string, lang string, max_stars_repo_name string, max_stars_repo_path string")
    assert [r["content"] for r in hub.project_starred(df, per_language=1).collect()] == ["a"]
    assert hub.project_documents(df).columns == ["content", "lang", "license", "repo", "path"]
    assert hub.folder_of("python") == "Python" and hub.folder_of("zig") == "zig"


def test_pipeline(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    doc = {"content": GOOD, "lang": "python", "license": "mit"}
    write(raw / "1.jsonl", [json.dumps(doc), "oops", json.dumps(doc | {"lang": "java"})])
    write(raw / "2.jsonl", [json.dumps(doc), json.dumps(doc | {"content": GOOD + "# more\n"})])
    stats = pipeline.filter_all(spark, str(raw), str(tmp_path / "f")).first().asDict()
    assert (stats["total"], stats["accepted"], stats["dedup_filtered"], stats["lang_filtered"]) == (5, 2, 1, 1)
    seen = spark.read.parquet(str(tmp_path / "f"))
    again = pipeline.filter_all(spark, str(raw), str(tmp_path / "g"), seen=seen).first()
    assert again["accepted"] == 0 and again["dedup_filtered"] == 3
    assert pipeline.run_steps([("a", lambda: None)]) == ["a"]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "mem")
    docs = spark.createDataFrame([(GOOD, "python", "mit"), (GOOD, "python", "mit"), ("x", "python", "mit")], "content string, lang string, license string")
    docs.write.parquet(source)
    stream = incremental.filter_stream(spark.readStream.schema(docs.schema).parquet(source))
    run = stream.writeStream.format("memory").queryName("kept").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("kept").count() == 1
    vectors = spark.createDataFrame([(k, [1.0, float(k)], f"t{k}") for k in range(4)], "n int, embedding array<double>, text string")
    vectors.coalesce(1).write.parquet(str(tmp_path / "v"))
    run = incremental.remember(spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "v")), out, 2, 3, order=["n"]).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["text"] for r in incremental.recall(spark, out).collect()) == ["t1", "t2", "t3"]
    again = incremental.remember(spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "v")), out, 2, 3, order=["n"]).start()
    again.processAllAvailable()  # the same epoch once more
    again.stop()
    assert sorted(r["text"] for r in incremental.recall(spark, out).collect()) == ["t1", "t2", "t3"]


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["total"] == 200
    names = set(entry.queries())
    assert set(core.QUERIES) <= names and set(entry.oracle_sql()) <= names

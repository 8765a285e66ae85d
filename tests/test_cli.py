"""The command line over small folders."""

from __future__ import annotations

import json

import numpy as np

from heddle import cli


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("*.json")) for x in f.read_text().splitlines()]


def jsonl(folder, rows):
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(folder)


def test_mix_and_order(spark, tmp_path):
    one = jsonl(tmp_path / "one", [{"content": f"a = {k}", "lang": "python", "path": f"{k}.py"} for k in range(80)])
    two = jsonl(tmp_path / "two", [{"content": f"b{k}", "lang": "python"} for k in range(40)])
    cli.main(["mix", one, two, str(tmp_path / "mixed"), "--ratio", "0.2"])
    got = lines(tmp_path / "mixed")
    assert sum(r["origin"] == "distilled" for r in got) == 20 and len(got) == 100
    raw = jsonl(tmp_path / "raw", [{"content": "class A:\n    def f(self):\n        if x:\n            return 1\n" * 3}, {"content": "x = 1"}])
    cli.main(["order", raw, str(tmp_path / "ordered")])
    assert [r["content"][:5] for r in lines(tmp_path / "ordered")] == ["x = 1", "class"]
    cli.main(["order", raw, str(tmp_path / "hard"), "--reverse"])
    assert [r["content"][:5] for r in lines(tmp_path / "hard")] == ["class", "x = 1"]


def test_pack_and_stream(spark, tmp_path):
    tokens = str(tmp_path / "tokens")
    spark.createDataFrame([("b", [4, 5, 6]), ("a", [1, 2, 3])], "hash string, ids array<int>").write.parquet(tokens)
    cli.main(["pack", tokens, str(tmp_path / "packed"), "--length", "2"])
    assert sorted(r["input_ids"] for r in spark.read.parquet(str(tmp_path / "packed")).collect()) == [[1, 2], [4, 5]]
    cli.main(["stream", tokens, str(tmp_path / "s.bin")])
    assert np.fromfile(tmp_path / "s.bin", "<i4").tolist() == [1, 2, 3, 4, 5, 6]


def test_project_and_search(spark, tmp_path, capsys):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([("x", "python", "a/b", "c.py"), (" ", "python", "a/b", "d.py")], "content string, lang string, max_stars_repo_name string, max_stars_repo_path string").write.parquet(docs)
    cli.main(["project", docs, str(tmp_path / "out"), "--starred"])
    assert [r["license"] for r in lines(tmp_path / "out")] == ["permissive"]
    labelled = str(tmp_path / "labelled")
    spark.createDataFrame([("long enough " * 20, True), ("short", False)], "content string, good boolean").write.parquet(labelled)
    cli.main(["search", labelled, json.dumps({"least": [10, 1000], "score": [0.0]})])
    shown = capsys.readouterr().out
    assert '{"least": 10, "score": 0.0}' in shown and "1.0" in shown
    cli.main(["search", labelled, json.dumps({"least": [10], "score": [0.0, 0.1]}), "--trials", "3"])

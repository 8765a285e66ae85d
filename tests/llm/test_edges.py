"""Nulls, repeated rows, nothing, and columns of clashing names, for the operators whose other tests leave them out."""

from __future__ import annotations

import hashlib

from heddle.llm import chat, substrings, tokenfiles
from heddle.llm.queries import vocabulary


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(df).isEmpty()
    one = spark.createDataFrame([(None, None, None, None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    chat.rotate(one).collect()


def test_repeated_bytes_with_null_and_repeated_keys(spark):
    shared, own = "s" * 120 + "hared passage " * 12, "quite another text"
    rows = [(None, shared, "x"), (None, shared, "x"), (1, shared + own, "y"), (1, None, "y"), (2, "", "z"), (None, own, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3)
    got = sorted((tuple(r) for r in substrings.repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n, m = len(shared), len(own)
    want = [(None, n, n, 1, sha(""))] * 2 + [(1, n + m, n, 1, sha(own)), (1, 0, 0, 0, sha("")), (2, 0, 0, 0, sha("")), (None, m, 0, 0, sha(own))]
    assert got == sorted(want, key=str)


def test_token_files_with_null_and_repeated_keys(spark, tmp_path):
    rows = [(5, "b c", 1), (None, "a", 2), (5, "b c", 3), (None, None, 4), (3, "d", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    path = str(tmp_path / "t")
    got = tokenfiles.token_file_digests(df, vocabulary("word_bpe_49k.json"), path=path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 3, 5, 5]
    starts = [0]
    for r in got:
        assert r["start"] == starts[-1]
        starts.append(starts[-1] + r["n_tokens"])
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 2, 3, 3] and got[3]["ids_crc32"] == got[4]["ids_crc32"]

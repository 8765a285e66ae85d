"""The stages on a small corpus, each against the plain version of its operator on the stage's own input."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline as p
from heddle.llm import quality
from heddle.sources import shared
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        before = docs
        docs = shared.materialise(stage(spark, docs, SF), "test-stage")
        out.append((name, before, docs))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages):
    first = stages[0][1].columns
    assert [n for n, _, _ in stages] == [n for n, _ in p.STAGES]
    assert all(after.columns == first for _, _, after in stages[:-1])


def test_each_stage_takes_effect(spark, stages):
    (_, raw, good), (_, _, near), (_, _, cut), (_, _, clean), (_, _, tokens) = stages
    kept = {r["doc_id"] for r in quality.judge(raw).where("kept").collect()}
    assert set(texts(good)) == kept and texts(good).items() <= texts(raw).items()
    before = sorted(texts(good).items())
    assert sorted(texts(near)) == brute.near_survivors(before)
    before = sorted(texts(near).items())
    after = texts(cut)
    for (i, t), (_, removed, _, _) in zip(before, brute.repeats([t for _, t in before]), strict=True):
        assert (after[i] == t) == (removed == 0)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = texts(clean)
    hit = {r[0] for r in brute.contamination(sorted(after.items()), items) if r[-1]}
    assert all(left[i] == after[i] for i in after if i not in hit)
    assert not any(r[-1] for r in brute.contamination(sorted(left.items()), items))
    rows = tokens.collect()
    assert {r["doc_id"] for r in rows} == set(left) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_a_stage_deletes_what_the_one_before_has_left_unless_it_reads_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = p.quality_rules(spark, docs, SF)
    left = set(shared.written()) & p._left
    assert left
    lazily = p.near_dedup(spark, good, SF)  # reads the first stage's tables: they stay
    assert lazily.count() > 0
    kept = shared.materialise(lazily, "test-kept")
    p.benchmark_decontamination(spark, kept, SF).count()
    assert not left & set(shared.written()) and kept.count() > 0


def test_run_and_registration(spark, stages):
    assert {r["doc_id"] for r in p.run(spark, SF).select("doc_id").collect()} == {r["doc_id"] for r in stages[-1][2].collect()}
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13


def test_stages_on_nulls_repeats_and_nothing(spark):
    words = [f"w{k}x" for k in range(90)]
    whole, other = " ".join(words), " ".join(f"o{k % 61}y{k}" for k in range(120))
    rows = [(1, whole, "en", "s", 1), (1, whole, "en", "s", 1), (None, whole, None, None, None), (None, None, None, None, None), (2, "", "en", None, 0)]
    rows += [(None, other, "de", "t", 5), (None, other, "de", "t", 5), (3, "é" * 30_000, "fr", "s", 2), (4, "one two", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = p.quality_rules(spark, docs, SF)
    assert sorted(map(tuple, good.collect()), key=str) == sorted([*rows[:3], *rows[5:7]], key=str)
    near = p.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r["text"])[:20] for r in near) == sorted([whole[:20], other[:20], "é" * 20, "one two", str(next(r["text"] for r in near if not r["text"]))])
    cut = {r["doc_id"]: r["text"] for r in p.suffix_dedup(spark, docs.where("doc_id is not null"), SF).collect()}
    assert cut == {1: "", 2: "", 3: "", 4: "one two"}
    clean = p.benchmark_decontamination(spark, docs, SF)
    assert sorted(map(str, texts(clean))) == sorted(map(str, texts(docs))) and clean.count() == len(rows)
    tokens = p.bpe_encoding(spark, docs, SF).collect()
    assert len(tokens) == len(rows) and sum(r["n_tokens"] == 0 for r in tokens) == 2
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).isEmpty()

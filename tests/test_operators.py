"""Mixing, packing, memory, clustering, probes, search, synthesis."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import cluster, estimates, memory, mixing, packing, probes, search, synth


@pytest.mark.parametrize("c,d,r,expected", [(80, 100, 0.2, (80, 20)), (1000, 1000, 0.3, (1000, 428)), (80, 10, 0.2, (40, 10)), (0, 5, 0.2, (0, 5)), (5, 0, 0.2, (5, 0))])
def test_mix_counts(c, d, r, expected):
    assert mixing.mix_counts(c, d, r) == expected


def test_mix(spark):
    with pytest.raises(ValueError):
        mixing.mix_counts(0, 0, 0.2)
    mixed = mixing.mix(spark.range(80), spark.range(100, 120), "id", 0.2)
    stats = mixing.mix_stats(mixed).first()
    assert stats["total"] == 100 and 0.15 <= stats["actual_distill_ratio"] <= 0.25
    again = mixing.mix(spark.range(80), spark.range(100, 120), "id", 0.2)
    assert sorted(r["id"] for r in mixed.collect()) == sorted(r["id"] for r in again.collect())


def packed(docs, length, pad=0):
    flat = [t for d in docs for t in d]
    out = []
    for k in range(0, len(flat), length + 1):
        c = flat[k : k + length + 1]
        if len(c) > 1:
            full = c + [pad] * (length + 1 - len(c))
            labels = [-100 if x == pad and len(c) <= length else x for x in full[1:]]
            out.append((full[:-1], labels))
    return out


@pytest.mark.parametrize("length", [1, 4, 7, 128])
def test_pack(spark, length):
    r = random.Random(length)
    docs = [[r.randint(0, 9) for _ in range(r.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "i long, ids array<int>")
    got = [(r["input_ids"], r["labels"]) for r in packing.pack(df, "ids", ["i"], length).orderBy("chunk").collect()]
    assert got == packed(docs, length)


def test_pack_edges(spark):
    df = spark.createDataFrame([(0, None), (1, [])], "i long, ids array<int>")
    assert packing.pack(df, "ids", ["i"], 4).isEmpty()
    row = spark.createDataFrame([(0, [7])], "i long, ids array<int>").select(packing.with_specials("ids").alias("x")).first()
    assert row["x"] == [1, 7, 2]


def test_curriculum_rank_is_stable(spark):
    rows = [(0, 2.0), (1, 1.0), (2, 2.0), (3, 1.0), (4, None)]
    df = spark.createDataFrame(rows, "i int, s double")
    up = {r["i"]: r["curriculum_rank"] for r in mixing.curriculum_rank(df, "s", ["i"]).collect()}
    down = {r["i"]: r["curriculum_rank"] for r in mixing.curriculum_rank(df, "s", ["i"], reverse=True).collect()}
    assert up == {4: 1, 1: 2, 3: 3, 0: 4, 2: 5} and down == {0: 1, 2: 2, 1: 3, 3: 4, 4: 5}


def test_memory(spark, tmp_path):
    r = np.random.default_rng(1)
    vectors = r.standard_normal((8, 16))
    rows = spark.createDataFrame([(k, v.tolist(), f"t{k}") for k, v in enumerate(vectors)], "n int, embedding array<double>, text string")
    kept = memory.append(memory.empty(spark), rows, 16, order=["n"])
    best = memory.retrieve(kept, vectors[3].tolist(), 3).collect()
    assert best[0]["text"] == "t3" and best[0]["similarity"] > 0.99
    assert [b["similarity"] for b in best] == sorted((b["similarity"] for b in best), reverse=True)
    assert all(b["similarity"] < 0.5 for b in memory.retrieve(kept, (-vectors[3]).tolist(), 3, -1.0).where("text = 't3'").collect())
    five = memory.append(memory.empty(spark), rows, 16, max_entries=5, order=["n"])
    assert sorted(x["text"] for x in five.collect()) == ["t3", "t4", "t5", "t6", "t7"]
    assert memory.evicted_count(kept, 5) == 3
    memory.save(kept, str(tmp_path / "m"))
    assert memory.load_or_create(spark, str(tmp_path / "m")).count() == 8
    assert memory.load_or_create(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(Exception, match="expected 3 dimensions"):
        memory.append(memory.empty(spark), rows, 3, order=["n"]).collect()


def test_clusters_of_separable_points(spark):
    r = np.random.default_rng(2)
    rows = []
    for c in range(3):
        center = np.zeros(8)
        center[c] = 1
        rows += [(len(rows) + k, (center + 0.05 * r.standard_normal(8)).tolist(), c) for k in range(15)]
    df = spark.createDataFrame(rows, "i long, v array<double>, c int").coalesce(2)
    centroids, value = cluster.fit(df, "v", "i", k=3, n_init=2, max_iter=6)
    assert value < 0.5
    groups = cluster.assign(df, "v", centroids).groupBy("c").agg(F.countDistinct("cluster").alias("n")).collect()
    assert all(g["n"] == 1 for g in groups)
    distances = df.select(F.explode(cluster.centroid_distances("v", centroids)).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert -1e-9 <= distances[0] and distances[1] <= 2 + 1e-9
    with pytest.raises(RuntimeError):
        cluster.assign(df, "v", [])


def test_labels_and_probes(spark):
    assert probes.label_set(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    r = np.random.default_rng(4)
    x = r.standard_normal((80, 6))
    df = spark.createDataFrame([(v.tolist(), "pos" if v[0] > 0 else "neg", float(100 * v[0])) for v in x], "v array<double>, y string, t double").coalesce(1)
    probe = probes.ClassificationProbe(["neg", "pos"]).fit(df, "v", "y")
    out = probe.predict(df, "v")
    assert out.agg(estimates.accuracy("predicted", "y")).first()[0] > 0.9
    assert abs(sum(out.first()["probabilities"]) - 1) < 1e-9
    fitted = probes.RegressionProbe("custom", "mse").fit(df, "v", "t").predict(df, "v")
    assert estimates.pearson(fitted, "predicted", "t").first()[0] > 0.99
    with pytest.raises(ValueError):
        probes.RegressionProbe("beauty")


def test_pearson_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert estimates.pearson(df, "a", "b").first()[0] == 0.0
    assert estimates.pearson(df.limit(0), "a", "b").first()[0] == 0.0


def test_search(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.1), (2, 0.8), (3, 0.3), (4, 0.1)], "trial_no long, score double")
    assert [r["trial_no"] for r in search.top_k(search.rank_trials(scores), 2).collect()] == [1, 4]

    def f(p):
        if p["x"] == 2:
            raise ValueError("bad point")
        return -((p["x"] - 3) ** 2)

    found = search.grid_search(spark, f, {"x": [0, 1, 2, 3, 4]}, "maximize").collect()
    assert found and [r["params"] for r in found if r["rank"] == 1] == ['{"x": 3}']
    assert [(r["trial_no"], r["rank"]) for r in found if r["error"]] == [(2, 5)]
    a, b = search.random_points({"x": (0.0, 1.0, float), "n": (2, 8, int), "c": ["u"], "f": lambda: 7, "k": 5, "pair": (1, 2)}, 15), None
    b = search.random_points({"x": (0.0, 1.0, float), "n": (2, 8, int), "c": ["u"], "f": lambda: 7, "k": 5, "pair": (1, 2)}, 15)
    assert a == b and all(2 <= p["n"] <= 8 and p["f"] == 7 and p["k"] == 5 for p in a)
    assert search.grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]


def test_synthesis(spark):
    rows = synth.synthetic_instances(spark, 7).orderBy("instance").collect()
    assert rows[0]["topic"] == rows[6]["topic"] and "<think>" in rows[0]["content"] and "{" in rows[2]["content"]
    assert synth.db_call_examples(spark, 2).count() == 16
    with pytest.raises(ValueError):
        synth.db_call_json("oracle", "select", "t", {})


def test_estimates(spark):
    df = spark.createDataFrame([("a" * 37,), ("b" * 37,)], "c string")
    row = estimates.estimate_tokens(df, "c").first()
    assert (row["documents"], row["total_chars"], row["estimated_tokens"]) == (2, 74, 20)
    assert estimates.estimate_tokens(df.limit(0), "c").first()["estimated_tokens"] == 0
    ids = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert estimates.token_sufficiency(ids, "ids", 3).first()["status"] == "SUFFICIENT"
    assert estimates.token_sufficiency(ids, "ids", 6).first()["status"] == "INSUFFICIENT (50.0%)"
    assert estimates.token_sufficiency(ids.limit(0), "ids").isEmpty()
    assert estimates.feed_forward_width(1024) == 2816

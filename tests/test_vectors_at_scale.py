"""Pruned search, the memory that grows by appending, training over partitions, embeddings by length."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import blocks, embedding, memory, nearest, probes, segments, training

VECTORS = "idx long, key array<double>, text string"


def clustered(n, dim=16, centres=12, seed=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return c[r.integers(0, centres, n)] + 0.15 * r.normal(size=(n, dim))


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v], f"t{k}") for k, v in enumerate(vectors)], VECTORS).repartition(5)


def whole(vectors, asked, k, threshold, decimals):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = []
    for q in asked:
        s = unit @ unit[q]
        s = np.round(s, decimals) + 0.0 if decimals is not None else s
        out += [(q, int(i), n + 1) for n, i in enumerate([i for i in np.argsort(-s, kind="stable") if s[i] >= threshold][:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "threshold", "decimals", "slice_rows"), [(3, 0.0, 6, 50_000), (10, 0.9, 4, 40), (500, -1.0, 6, 100), (1, 0.999, None, 7)])
def test_pruned_search_is_the_full_scan(spark, k, threshold, decimals, slice_rows):
    vectors = clustered(1500)
    vectors[700:900] = vectors[0]  # a mass of one vector, with ties by index
    df, asked = frame(spark, vectors), list(range(0, 1500, 20))
    index = nearest.build(df, sample=300, slice_rows=slice_rows)
    got = index.search(df.where("idx % 20 = 0"), k, threshold, decimals=decimals)
    assert sorted((r["query"], r["index"], r["rank"]) for r in got.collect()) == whole(vectors, asked, k, threshold, decimals)
    assert index.compared <= 75 * 1500
    if k < 100:
        assert index.compared < 0.5 * 75 * 1500


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 0.0], "zero"), (2, None, "null"), (3, [1.0, 0.0, 0.0], "longer"), (4, [-1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r["query"], r["index"]) for r in memory.retrieve_each(df, df, 2, -1.0).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (4, 4), (4, 1)}
    assert memory.retrieve_each(df.limit(0), df, 2).isEmpty() and memory.retrieve_each(df, df.limit(0), 2).isEmpty()


def test_appended_memory(spark, tmp_path):
    path, rows = str(tmp_path / "m"), frame(spark, clustered(60)).withColumnRenamed("key", "embedding").drop("idx")
    assert segments.load(spark, path).isEmpty()
    parts = [rows.where(F.pmod(F.crc32("text"), F.lit(3)) == k) for k in range(3)]
    made = [segments.append(p, path, 16, order=["text"]) for p in parts]
    assert made[1].first == made[0].upto + 1 and segments.append(rows.limit(0), path, 16) is None
    want = [r["text"] for p in parts for r in p.orderBy("text").collect()]
    assert [r["text"] for r in segments.load(spark, path).orderBy("idx").collect()] == want
    # Only the folders that can hold the newest entries are opened.
    newest = segments.load(spark, path, 5)
    assert [r["text"] for r in newest.orderBy("idx").collect()] == want[-5:]
    assert all(f"upto={made[2].upto}" in f for f in newest.inputFiles())
    # An append that fails or was cut off leaves nothing that is read.
    with pytest.raises(Exception, match="expected 16 dimensions"):
        segments.append(spark.createDataFrame([([1.0], "bad")], "embedding array<double>, text string"), path, 16)
    cut = tmp_path / "m" / "generation=0" / f"first={made[2].upto + 1}" / f"upto={made[2].upto + 9}"
    cut.mkdir(parents=True)
    (cut / "part-0.parquet").write_bytes(b"broken")
    assert segments.load(spark, path).count() == 60
    whole_ = segments.compact(spark, path, 40)
    assert whole_.generation == 1 and segments.segments(spark, path) == [whole_]
    assert [r["text"] for r in segments.load(spark, path).orderBy("idx").collect()] == want[-40:]
    again = segments.append(parts[0], path, 16, order=["text"])
    assert (again.generation, again.first) == (1, 60) and segments.load(spark, path, 1000).count() == 40 + parts[0].count()


def test_blocks_of_an_order(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)  # 150 blocks
    r = np.random.default_rng(1)
    rows = [(k, None if x < 0 else float(x), int(n)) for k, (x, n) in enumerate(zip(r.integers(-2, 9, 3000), r.integers(0, 5, 3000), strict=True))]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        calls.add(1)
        return x

    df = spark.createDataFrame(rows, "id long, x double, n int").repartition(6).withColumn("x", slow("x"))
    got = {r["id"]: r["before"] for r in blocks.running_before(df, F.col("n"), [F.col("x"), F.col("id")], "before").collect()}
    total = 0
    for k, _, n in sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, t[0])):
        assert got[k] == total
        total += n
    assert calls.value == 3000  # the key is computed once a row
    firsts = blocks.first_rows(df.drop("x"), [-F.col("n"), F.col("id")], 7).collect()
    assert sorted(r["id"] for r in firsts) == sorted(k for k, _, _ in sorted(rows, key=lambda t: (-t[2], t[0]))[:7])


def by_hand(x, y, net, s):
    """Mini-batch AdamW with gradients by finite differences of the loss."""
    m, v, steps, w = np.zeros_like(net.weights), np.zeros_like(net.weights), 0, net.weights.copy()
    for epoch in range(s.epochs):
        order = np.random.default_rng([s.seed, epoch]).permutation(len(x))
        for low in range(0, len(x), s.batch):
            at, g = order[low : low + s.batch], np.zeros_like(w)
            value = lambda u: training._loss(training.Net(net.sizes, u).apply(x[at]), y[at], s.loss)[0]  # noqa: B023, E731
            for k in range(len(w)):
                d = np.zeros_like(w)
                d[k] = 1e-6
                g[k] = (value(w + d) - value(w - d)) / 2e-6
            steps += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - s.rate * s.decay) - s.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return w


@pytest.mark.parametrize(("loss", "hidden"), [("mse", 4), ("huber", 4), ("cross entropy", 4), ("mse", None)])
def test_training_agrees_with_a_trainer_by_hand(spark, loss, hidden):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 3))
    y = r.integers(0, 3, 40).astype(float) if loss == "cross entropy" else 3 * x[:, 0] - x[:, 1]
    df = spark.createDataFrame([([float(a) for a in v], float(t)) for v, t in zip(x, y, strict=True)], "v array<double>, t double").coalesce(1)
    s = training.Settings(loss, epochs=3, batch=16, rate=0.01)
    outputs = 3 if loss == "cross entropy" else 1
    got = training.train(df, "v", "t", outputs, s, hidden)
    want = by_hand(x, y[:, None], training.Net.fresh(3, outputs, hidden, s.seed), s)
    assert np.abs(got.weights - want).max() < 1e-4 and len(got.losses) == 3


def test_hidden_layer_probes(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 8))
    target = np.maximum(x[:, 0], 0) * 2 + x[:, 1]
    rows = [([float(a) for a in v], float(t), "pos" if a * b > 0 else "neg") for v, t, a, b in zip(x, target, x[:, 0], x[:, 1], strict=True)]
    df = spark.createDataFrame(rows, "v array<double>, t double, y string").repartition(20)
    probe = probes.ClassificationProbe(["neg", "pos"], hidden=32, epochs=40, rate=0.01, dropout=0.0).fit(df, "v", "y")
    assert probe.losses[-1] < 0.5 * probe.losses[0]
    out = probe.predict(df, "v")
    assert out.where("predicted = y").count() > 540  # no line tells these classes apart
    assert out.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).isEmpty()
    probe.save(str(tmp_path / "c"))
    again = probes.ClassificationProbe.load(str(tmp_path / "c")).predict(df, "v")
    assert again.select("v", "predicted").exceptAll(out.select("v", "predicted")).isEmpty()
    for loss in ("mse", "huber"):
        fitted = probes.RegressionProbe("custom", loss, hidden=32, epochs=40, rate=0.01).fit(df, "v", "t")
        assert fitted.predict(df, "v").agg(F.corr("predicted", "t")).first()[0] > 0.95
    fitted.save(str(tmp_path / "r"))
    assert probes.RegressionProbe.load(str(tmp_path / "r")).predict(df, "v").agg(F.corr("predicted", "t")).first()[0] > 0.95
    both = df.withColumn("two", F.array("t", F.col("t") * -1))
    pair = probes.RegressionProbe(hidden=16, epochs=5).fit(both, "v", "two").predict(both.limit(3), "v").collect()
    assert all(len(p["predicted"]) == 2 for p in pair)
    with pytest.raises(ValueError, match="no rows"):
        training.train(df.limit(0), "v", "t", 1, training.Settings("mse"))


def tiny(ids, mask):
    """States that depend on all ids up to their place, and garbage at masked places."""
    states = np.stack([np.cumsum(ids, 1), ids * ids, np.broadcast_to(np.arange(ids.shape[1]), ids.shape)], 2).astype(float)
    return np.where(mask[:, :, None] > 0, states, 1e9)


@pytest.mark.parametrize("how", ["last", "mean"])
def test_embedding_equals_one_by_one(spark, how):
    r = np.random.default_rng(2)
    lists = [r.integers(1, 50, n).tolist() for n in [*r.integers(0, 30, 200), 500]] + [None]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>").repartition(3)
    got = {x["k"]: x["e"] for x in df.select("k", embedding.embed("ids", lambda: tiny, how, budget=64).alias("e")).collect()}
    for k, ids in enumerate(lists):
        if not ids:
            assert got[k] is None
            continue
        states = tiny(np.array([ids]), np.ones((1, len(ids))))[0]
        assert got[k] == pytest.approx(states[-1] if how == "last" else states.mean(0))


def test_batches_stay_within_the_budget():
    lengths = np.random.default_rng(3).integers(0, 90, 500)
    seen = [rows for rows in embedding.batches(lengths, 256)]
    assert sorted(k for rows in seen for k in rows) == np.flatnonzero(lengths).tolist()
    assert all(len(rows) * lengths[rows].max() <= 256 for rows in seen)


def test_probes_that_beat_the_most_frequent_label_a_little_have_learned(spark, tmp_path):
    from heddle.plans.queries import probe_quality

    r = np.random.default_rng(8)
    x = r.standard_normal((4000, 8)) * 0.12
    labels = np.where(r.random(4000) < 0.04, (x[:, 2] > 0).astype(int), r.integers(0, 10, 4000))
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = probe_quality(spark, str(tmp_path)).collect()
    assert [(row["probe"], row["n"], row["learned"]) for row in got] == [(k, 4000, True) for k in ("linear", "hidden", "mse", "huber")]

"""Spherical k-means over an embedding column."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import let
from heddle.functions.vectors import argmax, dot, l2_normalise
from heddle.sources.shared import materialise

EPSILON = 1e-12


def _literal(centroids: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])


def similarities(embedding: str | Column, centroids: list[list[float]]) -> Column:
    """Cosine to each centroid; the centroids, a model's few vectors, are literals of the plan."""
    c = F.col(embedding) if isinstance(embedding, str) else embedding
    units = (np.array(centroids) / (np.linalg.norm(centroids, axis=1, keepdims=True) + EPSILON)).tolist()
    return let(l2_normalise(c, EPSILON, added=True), lambda v: F.transform(_literal(units), lambda u: dot(v, u)))


def assign(df: DataFrame, embedding: str, centroids: list[list[float]]) -> DataFrame:
    """``df`` with ``cluster``: the most similar centroid, the first of equals."""
    if not centroids:
        raise RuntimeError("fit before assigning")
    return df.withColumn("cluster", argmax(similarities(embedding, centroids)))


def centroid_distances(embedding: str | Column, centroids: list[list[float]]) -> Column:
    """1 - cosine to each centroid."""
    return F.transform(similarities(embedding, centroids), lambda s: 1 - s)


def centroid_means(df: DataFrame, embedding: str, cluster: str) -> DataFrame:
    """Unit mean vector of each cluster: cluster, centroid."""
    tall = df.select(F.col(cluster).alias("cluster"), F.posexplode(l2_normalise(embedding, EPSILON, added=True)).alias("pos", "x"))
    means = tall.groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    vectors = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))  # one vector
    return vectors.select("cluster", l2_normalise(F.transform("v", lambda x: x["x"]), EPSILON, added=True).alias("centroid"))


def inertia(df: DataFrame, embedding: str, centroids: list[list[float]]) -> DataFrame:
    """Mean of 1 - cosine to the nearest centroid."""
    return df.agg(F.avg(1 - F.array_max(similarities(embedding, centroids))).alias("inertia"))


def _units(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + EPSILON)


def _drawn(batches: Iterator[pa.RecordBatch], chosen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows the one that wins each run's race: (run, time, order, unit vector)."""
    best: dict[int, tuple[float, str, list[float]]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        v, orders = _units(batch.column("v")), batch.column("o")
        draws = _rows(batch.column("u"))
        for run, centroids in enumerate(chosen):
            weight = np.maximum(1 - (v @ centroids.T).max(1), 0.0) if len(centroids) else np.ones(len(v))
            race = -np.log(draws[:, run]) / np.maximum(weight, 1e-300)
            for at in np.flatnonzero(race == race.min()).tolist():
                found = (float(race[at]), orders[at].as_py(), v[at].tolist())
                best[run] = min(best.get(run, found), found)
    rows = [(run, *found) for run, found in best.items()]
    kinds = [pa.int32(), pa.float64(), pa.string(), pa.list_(pa.float64())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["run", "t", "o", "v"])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _draw(rows: DataFrame, chosen: list[np.ndarray], salts: list[int]) -> list[np.ndarray]:
    """One more unit vector for each run: k-means++ with chances proportional to the distance, as an exponential race.

    Every task passes on its own winner of each run; the smallest time wins.
    """
    draw = lambda salt: (F.shiftrightunsigned(F.xxhash64("o", F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)
    raced = rows.select("v", "o", F.array(*map(draw, salts)).alias("u"))
    found = raced.mapInArrow(lambda it: _drawn(it, chosen), "run int, t double, o string, v array<double>")
    winners = found.groupBy("run").agg(F.min(F.struct("t", "o", "v")).alias("w")).collect()
    if not winners:
        raise ValueError("no rows to cluster")
    by_run = {r["run"]: np.array(r["w"]["v"]) for r in winners}
    return [by_run[run] for run in range(len(chosen))]


def init_centroids(df: DataFrame, embedding: str, order: str, k: int, seed: int, runs: int = 1) -> list[np.ndarray]:
    """First centroids of several runs; the runs draw together, so it takes ``k`` passes."""
    rows = df.select(F.col(embedding).alias("v"), F.col(order).cast("string").alias("o"))
    chosen = [np.zeros((0, 0)) for _ in range(runs)]
    dice = [random.Random(seed + run) for run in range(runs)]
    for _ in range(k):
        fresh = _draw(rows, chosen, [r.getrandbits(40) for r in dice])
        chosen = [np.vstack([c, f[None]]) if len(c) else f[None] for c, f in zip(chosen, fresh, strict=True)]
    return chosen


def _moved(batches: Iterator[pa.RecordBatch], centroids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows and each run: sums of the unit vectors of each cluster, their numbers, and the distances' sum."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _units(batch.column("v"))
        parts = []
        for c in centroids:
            near = v @ c.T
            own = near.argmax(1)
            member = np.zeros((len(c), len(v)))
            member[own, np.arange(len(v))] = 1.0
            parts += [(member @ v).ravel(), member.sum(1), [(1 - near.max(1)).sum()]]
        packed = np.concatenate(parts)
        total = packed if total is None else total + packed
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("s").to_pylist():
            total = np.frombuffer(blob) if total is None else total + np.frombuffer(blob)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])


def _step(rows: DataFrame, centroids: list[np.ndarray], parts: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(sums, numbers, summed distance) of each run after one pass; the sums meet in two levels."""
    sums = rows.mapInArrow(lambda it: _moved(it, centroids), "s binary")
    if parts > 16:
        sums = sums.repartition(math.isqrt(parts)).mapInArrow(_added, "s binary")
    total = np.sum([np.frombuffer(r["s"]) for r in sums.collect()], axis=0)
    out, at = [], 0
    for c in centroids:
        n = c.size
        out.append((total[at : at + n].reshape(c.shape), total[at + n : at + n + len(c)], float(total[at + n + len(c)])))
        at += n + len(c) + 1
    return out


def fit(df: DataFrame, embedding: str, order: str, k: int = 8, n_init: int = 5, max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> tuple[list[list[float]], float]:
    """Centroids and inertia of the best of ``n_init`` runs of full Lloyd steps; a dead cluster draws a new point.

    All runs that are not done step together, so a step is one pass over the table, which is written once as it is needed; the
    driver gets sums of the size of the centroids.
    """
    rows = materialise(df.where(F.col(embedding).isNotNull()).select(F.transform(embedding, lambda x: x.cast("double")).alias("v"), F.col(order).cast("string").alias("o")), "k-means")
    centroids = init_centroids(rows, "v", "o", k, seed, n_init)
    parts, running = rows.rdd.getNumPartitions(), list(range(n_init))
    for step in range(max_iter):
        found = _step(rows, [centroids[r] for r in running], parts)
        still = []
        for run, (sums, n, _) in zip(running, found, strict=True):
            size = np.linalg.norm(sums / np.maximum(n, 1)[:, None], axis=1, keepdims=True) + EPSILON
            new = sums / np.maximum(n, 1)[:, None] / size
            dead = np.flatnonzero(n == 0)
            if len(dead):
                new[dead] = init_centroids(rows, "v", "o", len(dead), seed + 1000 * (run + 1) + step)[0]
            shift = float(np.abs(new - centroids[run]).max())
            centroids[run] = new
            if shift >= tol:
                still.append(run)
        running = still
        if not running:
            break
    count = rows.count()
    values = [total / count for _, _, total in _step(rows, centroids, parts)]
    best = int(np.argmin(values))
    return centroids[best].tolist(), values[best]

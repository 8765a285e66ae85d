"""Exact nearest vectors by cosine with pruning: cells of vectors around centroids, and the balls that hold them.

On the unit sphere the angle is a distance, so for a query at angle a from a cell's centroid and a cell of radius r, no vector of
the cell is nearer than a - r. A query first visits the nearest cells that hold enough vectors between them; its k-th best there
is a bound, and of the other cells it visits those whose ball reaches over the bound. What is skipped cannot win.

The centroids are learned on a bounded sample; every vector is indexed. Vectors and queries meet by cell: a large cell is dealt
into slices, its vectors are sent once and stay in memory, queries stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.vectors import l2_normalise
from heddle.sources.shared import materialise

#: Vectors that the centroids are learned on, at most so many centroids, and steps of learning.
SAMPLE, CENTROIDS, STEPS = 20_000, 1024, 8
#: Vectors of a cell that one task holds, and queries that are multiplied with them at once.
SLICE, TOGETHER = 50_000, 256
#: Room for rounding errors in bounds.
SLACK = 1e-9


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def learn(vectors: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """``n`` unit centroids of unit vectors, by Lloyd steps from seeded rows; the first of equals takes a row."""
    start = np.random.default_rng(seed).permutation(len(vectors))[:n]
    centroids = vectors[np.sort(start)]
    for _ in range(STEPS):
        nearest = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


@dataclass
class Index:
    """Indexed vectors: rows (_id, _v, _cell, _slice), the centroids, and of each cell its radius, vectors and slices."""

    rows: DataFrame
    kind: str
    centroids: np.ndarray
    radius: np.ndarray
    held: np.ndarray
    slices: np.ndarray
    #: Pairs of a query and a vector that the last search has compared.
    compared: int = 0

    def search(self, queries: DataFrame, k: int = 3, threshold: float = 0.0, *, key: str = "key", idx: str = "idx", decimals: int | None = None) -> DataFrame:
        """The ``k`` most similar vectors at or over a cosine threshold for each query: query, index, similarity, rank.

        Ties go by index. With ``decimals`` similarities are rounded before they are ordered. Queries that are null or of another
        length than the vectors get no rows.
        """
        dim, slack = self.centroids.shape[1], SLACK + (0 if decimals is None else 10.0**-decimals)
        asked = materialise(
            queries.where(F.size(key) == dim).select(F.col(idx).alias("_id"), l2_normalise(key).alias("_v")), "nearest-queries"
        )
        first = self._meet(_routed(asked, self, k, None, threshold, slack), k, decimals, "nearest-first")
        bound = first.groupBy("_q").agg(F.sort_array(F.collect_list("_s"), asc=False).alias("_best"))
        known = asked.join(bound.select("_q", F.get("_best", F.lit(k - 1)).alias("_bound")), F.col("_id") == F.col("_q"), "left").drop("_q")
        rest = self._meet(_routed(known, self, k, "_bound", threshold, slack), k, decimals, "nearest-rest")
        place = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("_s").desc(), "_i"))
        found = first.select("_q", "_i", "_s").unionByName(rest.select("_q", "_i", "_s")).where(F.col("_s") >= threshold)
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        return best.select(F.col("_q").alias("query"), F.col("_i").alias("index"), F.col("_s").alias("similarity"), "rank")

    def _meet(self, routed: DataFrame, k: int, decimals: int | None, label: str) -> DataFrame:
        """The ``k`` best of each slice for the queries that were sent to its cell: _q, _i, _s."""
        routes = materialise(routed, f"{label}-routes")
        counts = {r["_cell"]: r["n"] for r in routes.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        self.compared = (0 if label.endswith("first") else self.compared) + sum(int(self.held[c]) * n for c, n in counts.items())
        slices = F.element_at(F.array(*[F.lit(int(s)) for s in self.slices]), F.col("_cell") + 1)
        sent = routes.select("_id", "_v", "_cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"), F.lit(1).alias("_asks"))
        needed = self.rows.where(F.col("_cell").isin(list(counts)) if len(counts) < len(self.held) else F.lit(True)).withColumn("_asks", F.lit(0))
        both = needed.select("_id", "_v", "_cell", "_slice", "_asks").unionByName(sent)
        dealt = both.repartition("_cell", "_slice").sortWithinPartitions("_cell", "_slice", "_asks", "_id")
        out = f"_q {self.kind}, _i {self.kind}, _s double"
        return materialise(dealt.mapInArrow(lambda it: _best(it, k, decimals), out), label)


def _best(batches: Iterator[pa.RecordBatch], k: int, decimals: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, vectors before queries: each query's ``k`` best of the slice, ties by id."""
    ids: list[pa.Array] = []
    parts: list[np.ndarray] = []
    where, vectors, names = None, None, None
    for batch in batches:
        cells = np.stack([batch.column(c).to_numpy() for c in ("_cell", "_slice", "_asks")], 1)
        edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low == high:
                continue
            cell, piece, asks = cells[low].tolist()
            some = batch.slice(low, high - low)
            if (cell, piece) != where:
                where, ids, parts, vectors = (cell, piece), [], [], None
            if not asks:
                ids.append(some.column("_id"))
                parts.append(_matrix(some.column("_v")))
                continue
            if not parts:
                continue
            if vectors is None:
                vectors, names = np.concatenate(parts), pa.concat_arrays(ids)
                parts = [vectors]
                ids = [names]
            for at in range(0, some.num_rows, TOGETHER):
                part = some.slice(at, TOGETHER)
                found = _matrix(part.column("_v")) @ vectors.T
                found = found if decimals is None else np.round(found, decimals) + 0.0
                best = np.argsort(-found, axis=1, kind="stable")[:, :k]
                asked = np.repeat(np.arange(len(found)), best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(pa.array(asked)), names.take(pa.array(best.ravel())), pa.array(found[asked, best.ravel()])], ["_q", "_i", "_s"]
                )


def _routed(asked: DataFrame, index: Index, k: int, bound: str | None, threshold: float, slack: float) -> DataFrame:
    """Rows (_id, _v, _cell): each query with the cells it visits, first the nearest ones, then by their bounds."""
    centroids, radius, held = index.centroids, index.radius, index.held

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                away = _angles(_matrix(batch.column("_v")) @ centroids.T)
                order = np.argsort(away, axis=1, kind="stable")
                enough = np.cumsum(held[order], axis=1)
                near = np.zeros(away.shape, bool)  # the nearest cells up to that with the k-th vector
                np.put_along_axis(near, order, np.concatenate([np.zeros((len(away), 1), int), enough[:, :-1]], 1) < k, 1)
                if bound is None:
                    visits = near
                else:
                    least = np.array([threshold if b is None else max(b, threshold) for b in batch.column(bound).to_pylist()])
                    visits = ~near & (np.cos(np.maximum(away - radius - SLACK, 0.0)) >= (least - slack)[:, None])
                query, cell = np.nonzero(visits & (held > 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(query)), batch.column("_v").take(pa.array(query)), pa.array(cell.astype(np.int32))], ["_id", "_v", "_cell"]
                )

    return asked.mapInArrow(send, f"_id {index.kind}, _v array<double>, _cell int")


def build(memory: DataFrame, *, key: str = "key", idx: str = "idx", sample: int = SAMPLE, slice_rows: int = SLICE, seed: int = 42) -> Index | None:
    """Index every vector of ``memory`` that has the length of most of the sample; None where there is none.

    The sample is the rows with the least hashes of their ids. The number of centroids is the root of that of the vectors.
    """
    kind = memory.schema[idx].dataType.simpleString()
    few = memory.where(F.size(key) > 0).orderBy(F.xxhash64(idx), idx).limit(sample).select(F.transform(key, lambda x: x.cast("double")).alias("v")).collect()
    if not few:
        return None
    lengths = np.array([len(r["v"]) for r in few])
    dim = int(np.bincount(lengths).argmax())
    known = np.array([r["v"] for r in few if len(r["v"]) == dim], float)
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
    rows = memory.where(F.size(key) == dim).select(F.col(idx).alias("_id"), l2_normalise(key).alias("_v"))
    n = rows.count()
    centroids = learn(known, max(1, min(CENTROIDS, len(known), math.isqrt(n))), seed)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch.column("_v")) @ centroids.T
            cell = near.argmax(1)
            angle = _angles(near[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["_id", "_v", "_cell", "_angle"])

    celled = materialise(rows.mapInArrow(placed, f"_id {kind}, _v array<double>, _cell int, _angle double"), "nearest-index")
    radius, held = np.zeros(len(centroids)), np.zeros(len(centroids), int)
    for r in celled.groupBy("_cell").agg(F.max("_angle").alias("r"), F.count("*").alias("n")).collect():  # one row a cell
        radius[r["_cell"]], held[r["_cell"]] = r["r"], r["n"]
    slices = np.maximum(1, -(-held // slice_rows))
    many = F.element_at(F.array(*[F.lit(int(s)) for s in slices]), F.col("_cell") + 1)
    dealt = celled.select("_id", "_v", "_cell", F.pmod(F.xxhash64("_id"), many).cast("int").alias("_slice"))
    return Index(dealt, kind, centroids, radius, held, slices)

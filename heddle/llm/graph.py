"""Groups from links: inside a task, and over a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources.shared import materialise


class Forest:
    """Joins links as they come and gives one link for each fingerprint that is not its group's root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.parent]


def runs(batches: Iterator[pa.RecordBatch], columns: list[str], by: int | None = None) -> Iterator[list[np.ndarray]]:
    """Column arrays that each hold whole runs of the first ``by`` columns (all but the last); the input is sorted."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(now[0]):
            continue
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        last = np.ones(len(now[0]), bool)
        for c in now[: len(now) - 1 if by is None else by]:
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield [c[:cut] for c in now]
        rest = [c[cut:] for c in now]
    if rest is not None and len(rest[0]):
        yield rest


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round points every node at the smallest root among its neighbours' (only minima are gathered, so
    a hub costs one row per task), follows the pointers to their ends, and rewrites the links between the
    roots that are left. Rounds end when no link joins two roots. Each round is cut off by a written table.
    """
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    labels = materialise(
        links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")),
        "cc-labels",
    )
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("up")).where("up < a"), "cc-up")
        while True:  # pointer doubling: every pointer ends at a node that points nowhere
            further = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.a"), "left")
            jumped = materialise(
                further.select(F.col("x.a").alias("a"), F.coalesce("y.up", "x.up").alias("up"), F.col("y.up").isNotNull().alias("moved")), "cc-jump"
            )
            done = jumped.where("moved").isEmpty()
            up = jumped.select("a", "up")
            if done:
                break
        labels = materialise(
            labels.join(up, labels["root"] == up["a"], "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels"
        )
        a, b = up.select(F.col("a").alias("ka"), F.col("up").alias("ra")), up.select(F.col("a").alias("kb"), F.col("up").alias("rb"))
        moved = (
            links.join(a, links["a"] == F.col("ka"), "left")
            .join(b, links["b"] == F.col("kb"), "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        )
        links = materialise(
            moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links"
        )
    return labels

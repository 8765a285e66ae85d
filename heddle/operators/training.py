"""Small nets over embeddings, trained in parallel: a linear head or one hidden ReLU layer, by AdamW.

In each epoch every task starts from the same weights and moments, takes mini-batch steps over its own rows, and gives back what it
arrived at; the average by rows, summed in two levels, is what the next epoch starts from. Over one partition that is plain
mini-batch AdamW. The table is written once; a lost task repeats its epoch from the same start, so it gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.shared import materialise

LOSSES = ("cross entropy", "mse", "huber")
_SUMS = "n long, loss double, state binary"


@dataclass(frozen=True)
class Settings:
    """Of one training; ``huber`` turns from squared to absolute at an error of 1."""

    loss: str
    epochs: int = 20
    batch: int = 64
    rate: float = 1e-3
    decay: float = 1e-4
    dropout: float = 0.0
    seed: int = 42
    betas: tuple[float, float] = (0.9, 0.999)
    floor: float = 1e-8


@dataclass
class Net:
    """Weights as one vector with the shapes of (matrix, bias) a layer."""

    sizes: list[int]
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def fresh(cls, dim: int, out: int, hidden: int | None, seed: int) -> Net:
        """Uniform weights within one over the root of a layer's inputs."""
        sizes, r = [dim, *([hidden] if hidden else []), out], np.random.default_rng(seed)
        parts = [r.uniform(-1, 1, (a + 1) * b) / math.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]
        return cls(sizes, np.concatenate(parts))

    def layers(self, vector: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(matrix, bias) of each layer, as views."""
        vector, out, at = self.weights if vector is None else vector, [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(layers := self.layers()):
            x = x @ w + b
            if k < len(layers) - 1:
                x = np.maximum(x, 0.0)
        return x

    def gradient(self, x: np.ndarray, y: np.ndarray, loss: str, dropout: float = 0.0, r: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Mean loss of a batch and its gradient, as one vector."""
        layers, kept, inputs = self.layers(), [], [x]
        for k, (w, b) in enumerate(layers):
            z = inputs[-1] @ w + b
            if k < len(layers) - 1:
                mask = (z > 0).astype(float)
                if dropout:
                    mask *= (r.random(z.shape) >= dropout) / (1 - dropout)
                kept.append(mask)
                inputs.append(z * mask)
        value, back = _loss(z, y, loss)
        out = np.zeros_like(self.weights)
        for k in range(len(layers) - 1, -1, -1):
            w, b = self.layers(out)[k]
            w[:], b[:] = inputs[k].T @ back, back.sum(0)
            if k:
                back = (back @ layers[k][0].T) * kept[k - 1]
        return value, out


def _loss(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """Mean loss and its derivative by the outputs; of classes ``y`` holds the numbers."""
    if loss == "cross entropy":
        at = (np.arange(len(z)), y[:, 0].astype(int))
        logs = z - z.max(1, keepdims=True)
        logs = logs - np.log(np.exp(logs).sum(1, keepdims=True))
        back = np.exp(logs)
        back[at] -= 1.0
        return float(-logs[at].mean()), back / len(z)
    off = z - y
    if loss == "mse":
        return float((off**2).mean()), 2 * off / off.size
    small = np.abs(off) <= 1.0
    return float(np.where(small, 0.5 * off**2, np.abs(off) - 0.5).mean()), np.clip(off, -1.0, 1.0) / off.size


@dataclass
class State:
    """A net's weights, the moments of AdamW, and the steps taken."""

    net: Net
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def step(self, gradient: np.ndarray, s: Settings) -> None:
        self.steps += 1
        a, b = s.betas
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        rate = (self.first / (1 - a**self.steps)) / (np.sqrt(self.second / (1 - b**self.steps)) + s.floor)
        self.net.weights = self.net.weights * (1 - s.rate * s.decay) - s.rate * rate

    def packed(self) -> np.ndarray:
        return np.concatenate([self.net.weights, self.first, self.second, [self.steps]])

    @classmethod
    def unpacked(cls, sizes: list[int], vector: np.ndarray) -> State:
        n = (len(vector) - 1) // 3
        return cls(Net(sizes, vector[:n].copy()), vector[n : 2 * n].copy(), vector[2 * n : 3 * n].copy(), float(vector[-1]))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _epoch(batches: Iterator[pa.RecordBatch], sizes: list[int], start: np.ndarray, s: Settings, epoch: int) -> Iterator[pa.RecordBatch]:
    """One pass over a task's rows: (rows, summed loss, rows times what the state has become)."""
    state, n, total = State.unpacked(sizes, start), 0, 0.0
    r = np.random.default_rng([s.seed, epoch])
    for batch in batches:
        x, y = _rows(batch.column("x")), _rows(batch.column("y"))
        order = r.permutation(len(x))
        for low in range(0, len(x), s.batch):
            at = order[low : low + s.batch]
            value, gradient = state.net.gradient(x[at], y[at], s.loss, s.dropout, r)
            state.step(gradient, s)
            n, total = n + len(at), total + value * len(at)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([(state.packed() * n).tobytes()], pa.binary())], ["n", "loss", "state"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, loss, state = 0, 0.0, None
    for batch in batches:
        for row in batch.to_pylist():
            vector = np.frombuffer(row["state"])
            n, loss, state = n + row["n"], loss + row["loss"], vector if state is None else state + vector
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([state.tobytes()], pa.binary())], ["n", "loss", "state"])


def train(df: DataFrame, features: str, target: str, outputs: int, settings: Settings, hidden: int | None = None) -> Net:
    """A net trained on the rows of ``df``: an array of numbers, and the class's number, a value, or an array of values.

    The driver gets as many sums an epoch as the root of the number of partitions, each the size of the net. Rows with a null in
    either column are left out; a table without rows is an error.
    """
    if settings.loss not in LOSSES:
        raise ValueError(f"the loss is one of {LOSSES}")
    values = F.col(target) if df.schema[target].dataType.typeName() == "array" else F.array(target)
    rows = df.where(F.col(features).isNotNull() & F.col(target).isNotNull())
    data = materialise(rows.select(F.transform(features, lambda v: v.cast("double")).alias("x"), F.transform(values, lambda v: v.cast("double")).alias("y")), "training")
    one = data.first()
    if one is None:
        raise ValueError("no rows to train on")
    net = Net.fresh(len(one["x"]), outputs, hidden, settings.seed)
    state, sizes = State(net, np.zeros_like(net.weights), np.zeros_like(net.weights)), net.sizes
    parts = data.rdd.getNumPartitions()
    for epoch in range(settings.epochs):
        start = state.packed()
        sums = data.mapInArrow(lambda it, start=start, epoch=epoch: _epoch(it, sizes, start, settings, epoch), _SUMS)
        if parts > 16:
            sums = sums.repartition(math.isqrt(parts)).mapInArrow(_summed, _SUMS)
        found = sums.collect()
        n = sum(r["n"] for r in found)
        mean = np.sum([np.frombuffer(r["state"]) for r in found], axis=0) / n
        losses = [*state.net.losses, sum(r["loss"] for r in found) / n]
        state = State.unpacked(sizes, mean)
        state.net.losses = losses
    return state.net


def outputs(df: DataFrame, features: str, net: Net, name: str) -> DataFrame:
    """``df`` with the net's outputs, an array; null features give null."""
    sizes, weights = net.sizes, net.weights

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Net(sizes, weights)
        for part in parts:
            known = part[part.notna()]
            found = own.apply(np.stack(known.to_list()).astype(float)).tolist() if len(known) else []
            yield pd.Series(found, index=known.index, dtype=object).reindex(part.index)

    return df.withColumn(name, run(features))


def save(net: Net, path: str, **more: object) -> None:
    """One row of Parquet: the sizes, weights and losses, and what else the caller adds."""
    spark = SparkSession.active()
    row = {"sizes": net.sizes, "weights": net.weights.tolist(), "losses": net.losses, **more}
    kinds = "sizes array<int>, weights array<double>, losses array<double>" + "".join(f", {k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in more.items())
    spark.createDataFrame([tuple(row.values())], kinds).coalesce(1).write.mode("overwrite").parquet(path)


def load(path: str) -> tuple[Net, dict]:
    row = SparkSession.active().read.parquet(path).first().asDict()
    return Net(row.pop("sizes"), np.array(row.pop("weights")), row.pop("losses")), row

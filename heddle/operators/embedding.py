"""Embeddings of token lists by a model that the caller supplies: batches of like length under a budget, masked pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of a padded batch; a longer list runs alone.
BUDGET = 65_536

#: Takes ids and a mask (both batch x length), gives states (batch x length x width). Ids at masked places mean nothing.
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def batches(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Rows that run together: neighbours by length, whose number times the longest is within the budget; empty rows in none."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    low = 0
    for high in range(1, len(order) + 1):
        if high == len(order) or lengths[order[high]] * (high + 1 - low) > budget:
            yield order[low:high]
            low = high


def pooled(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """One vector a row: the state of the last id, or the mean over the ids."""
    if how == "last":
        return states[np.arange(len(states)), mask.sum(1).astype(int) - 1]
    return (states * mask[:, :, None]).sum(1) / mask.sum(1, keepdims=True)


def embed_lists(lists: list, model: Model, how: str, budget: int) -> list[list[float] | None]:
    lengths = np.array([0 if x is None else len(x) for x in lists], int)
    out: list[list[float] | None] = [None] * len(lists)
    for rows in batches(lengths, budget):
        longest = int(lengths[rows].max())
        ids, mask = np.zeros((len(rows), longest), np.int64), np.zeros((len(rows), longest))
        for k, row in enumerate(rows.tolist()):
            ids[k, : lengths[row]], mask[k, : lengths[row]] = lists[row], 1
        for row, vector in zip(rows.tolist(), pooled(np.asarray(model(ids, mask), float), mask, how).tolist(), strict=True):
            out[row] = vector
    return out


def embed(ids: Column | str, load: Callable[[], Model], how: str = "last", budget: int = BUDGET) -> Column:
    """The pooled state of a list of ids; null and empty lists give null.

    ``load`` makes the model, once a task. Rows of an Arrow batch run by length, so padding stays small and a batch never holds
    more ids than the budget, whatever the lists are like.
    """
    if how not in ("last", "mean"):
        raise ValueError("pool is 'last' or 'mean'")

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series(embed_lists(part.to_list(), model, how, budget), index=part.index, dtype=object)

    return run(ids)

"""Probes on embeddings: labels, classifiers, regressors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.vectors import argmax, softmax
from heddle.operators import training

# Default label sets and targets.
INTENTS = ("code_generation", "code_review", "refactor", "explain", "question", "debug", "test_writing", "documentation")
LANGUAGE_LABELS = ("python", "typescript", "javascript", "sql", "other")
TARGETS = ("quality_score", "complexity", "custom")
#: What a label that training has not seen adds to its odds.
UNSEEN = -1e9


def label_set(predefined: tuple[str, ...] | list[str], extra: list[str] | None = None) -> list[str]:
    """Distinct labels, the predefined ones first."""
    return list(dict.fromkeys([*predefined, *(extra or [])]))


def encode_label(label: str, labels: list[str]) -> Column:
    """Number of a label; one outside the set fails the query."""
    pairs = [x for k, name in enumerate(labels) for x in (F.lit(name), F.lit(float(k)))]
    found = F.try_element_at(F.create_map(*pairs), F.col(label))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))).cast("double"))


def decode_label(number: str, labels: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), (F.col(number) + 1).cast("int"))


def _features(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))


class ClassificationProbe:
    """A linear classifier (learned by Spark ML), or one with a hidden ReLU layer (AdamW over all partitions)."""

    def __init__(self, labels: list[str], hidden: int | None = None, max_iter: int = 50, seed: int = 42, *, epochs: int = 20, rate: float = 1e-3, batch: int = 64, dropout: float = 0.1):
        self.labels, self.hidden, self.max_iter, self.model = labels, hidden, max_iter, None
        self.settings = training.Settings("cross entropy", epochs, batch, rate, dropout=dropout, seed=seed)

    def fit(self, df: DataFrame, embedding: str, label: str) -> ClassificationProbe:
        coded = df.withColumn("_y", encode_label(label, self.labels))
        if self.hidden:
            self.model = training.train(coded, embedding, "_y", len(self.labels), self.settings, self.hidden)
            return self
        learner = LogisticRegression(labelCol="_y", maxIter=self.max_iter, family="multinomial", regParam=1e-4)
        found = learner.fit(_features(coded, embedding))
        weights, bias = found.coefficientMatrix.toArray(), found.interceptVector.toArray()
        unseen = len(self.labels) - len(bias)  # labels behind the last one that occurs
        bias = np.concatenate([bias, np.full(unseen, UNSEEN)])
        weights = np.vstack([weights, np.zeros((unseen, weights.shape[1]))])
        self.model = training.Net([weights.shape[1], len(bias)], np.concatenate([weights.T.ravel(), bias]), [float(x) for x in found.summary.objectiveHistory])
        return self

    @property
    def losses(self) -> list[float]:
        """Mean loss of each epoch, or of each step of the linear classifier."""
        return self.model.losses

    def predict(self, df: DataFrame, embedding: str) -> DataFrame:
        """``df`` with ``predicted`` (a label) and ``probabilities``."""
        if self.model is None:
            raise RuntimeError("fit before predicting")
        out = training.outputs(df, embedding, self.model, "_z").withColumn("probabilities", softmax("_z")).withColumn("_at", argmax("probabilities"))
        return out.withColumn("predicted", decode_label("_at", self.labels)).select(*df.columns, "predicted", "probabilities")

    def save(self, path: str) -> None:
        """The weights and the labels."""
        training.save(self.model, path, labels=self.labels)

    @classmethod
    def load(cls, path: str) -> ClassificationProbe:
        """A saved probe, ready to predict."""
        net, more = training.load(path)
        probe = cls(more["labels"], net.sizes[1] if len(net.sizes) > 2 else None)
        probe.model = net
        return probe


class RegressionProbe:
    """A linear regressor (Spark ML), or one with a hidden ReLU layer (AdamW); squared or Huber loss.

    With a hidden layer the target may be an array of numbers; the prediction then is one, too.
    """

    def __init__(self, target: str = "custom", loss: str = "mse", max_iter: int = 50, hidden: int | None = None, *, epochs: int = 20, rate: float = 1e-3, batch: int = 64, dropout: float = 0.1, seed: int = 42):
        if target not in TARGETS:
            raise ValueError(f"target is one of {TARGETS}")
        if loss not in ("mse", "huber"):
            raise ValueError("loss is 'mse' or 'huber'")
        self.target, self.loss, self.max_iter, self.hidden, self.model = target, loss, max_iter, hidden, None
        self.settings = training.Settings(loss, epochs, batch, rate, dropout=dropout, seed=seed)

    def fit(self, df: DataFrame, embedding: str, target: str) -> RegressionProbe:
        if self.hidden:
            values = F.size(target) if df.schema[target].dataType.typeName() == "array" else F.lit(1)
            width = df.where(F.col(target).isNotNull()).select(values.alias("n")).first()
            self.model = training.train(df, embedding, target, width["n"] if width else 1, self.settings, self.hidden)
            return self
        data = _features(df.withColumn("_y", F.col(target).cast("double")), embedding)
        loss = "squaredError" if self.loss == "mse" else "huber"
        found = LinearRegression(labelCol="_y", loss=loss, maxIter=self.max_iter, regParam=1e-6).fit(data)
        weights = found.coefficients.toArray()
        self.model = training.Net([len(weights), 1], np.append(weights, found.intercept))
        return self

    def predict(self, df: DataFrame, embedding: str) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit before predicting")
        out = training.outputs(df, embedding, self.model, "_z")
        return out.withColumn("predicted", F.col("_z") if self.model.sizes[-1] > 1 else F.col("_z")[0]).select(*df.columns, "predicted")

    def save(self, path: str) -> None:
        training.save(self.model, path, loss=self.loss)

    @classmethod
    def load(cls, path: str, target: str = "custom") -> RegressionProbe:
        """A saved probe, ready to predict."""
        net, more = training.load(path)
        probe = cls(target, more["loss"], hidden=net.sizes[1] if len(net.sizes) > 2 else None)
        probe.model = net
        return probe


def regression_suite() -> dict[str, RegressionProbe]:
    """Quality by squared, complexity by Huber loss."""
    return {"quality_score": RegressionProbe("quality_score", "mse"), "complexity": RegressionProbe("complexity", "huber")}

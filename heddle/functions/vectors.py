"""Array kernels: cosine, softmax, entropy, nucleus, schedules and rotary tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import col, let


def _doubles(c: Column | str) -> Column:
    return F.transform(col(c), lambda x: x.cast("double"))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_doubles(a), lambda x: x * x)))


def l2_normalise(a: Column | str, floor: float = 1e-12, added: bool = False) -> Column:
    """Unit vector; the length is floored at ``floor``, or with ``added`` increased by it."""
    size = norm(a) + floor if added else F.greatest(norm(a), F.lit(floor))
    return let(size, lambda n: F.transform(_doubles(a), lambda x: x / n))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def argmax(a: Column | str) -> Column:
    """Position from 0 of the first largest element."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    """Probabilities; the temperature is floored at 1e-5."""
    scaled = F.transform(_doubles(logits), lambda x: x / max(temperature, 1e-5))
    return let(
        scaled,
        lambda z: let(
            F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: let(_total(e), lambda s: F.transform(e, lambda x: x / s))
        ),
    )


def entropy(logits: Column | str) -> Column:
    """Shannon entropy of the softmax, in nats; vanishing probabilities add nothing."""
    return let(softmax(logits), lambda p: -_total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))))


def top_p(probabilities: Column | str, p: float) -> Column:
    """Which entries the nucleus keeps: those before which the larger ones sum to ``p`` or less; the first always."""
    own = _doubles(probabilities)
    ranked = F.transform(own, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("k"))

    def step(acc: Column, x: Column) -> Column:
        keeps = (acc["s"] <= p) | (F.size(acc["k"]) == 0)
        return F.struct((acc["s"] - x["n"]).alias("s"), F.when(keeps, F.array_append(acc["k"], x["i"])).otherwise(acc["k"]).alias("k"))

    kept = F.aggregate(F.array_sort(ranked), start, step, lambda acc: acc["k"])
    return let(kept, lambda k: F.transform(own, lambda _x, i: F.array_contains(k, i)))


def cosine_lr(step: Column | str, warmup: int, total: int, high: float, low: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine."""
    s = col(step)
    progress = (s - warmup) / max(1, total - warmup)
    return F.when(s < warmup, s * high / max(1, warmup)).otherwise(F.cos(progress * math.pi) * (0.5 * (high - low)) + (low + 0.5 * (high - low)))


def ntk_factor(original: Column | str, target: Column | str, dim: Column | str) -> Column:
    """Base scale for a longer context."""
    d = col(dim)
    return F.pow(col(target) / col(original), d / (d - 2))


def rotary_table(dim: int, position: Column | str, base: float = 10000.0, scale: float = 1.0) -> Column:
    """(cos, sin) of each frequency at a position."""
    rates = F.array(*[F.lit((base * scale) ** (-2 * k / dim)) for k in range(dim // 2)])
    return F.transform(rates, lambda r: F.struct(F.cos(col(position) * r).alias("cos"), F.sin(col(position) * r).alias("sin")))


def pool(states: Column | str, how: str = "last") -> Column:
    """One vector of an array of vectors: the last, or the mean."""
    if how == "last":
        return F.element_at(col(states), -1)
    if how != "mean":
        raise ValueError("pool is 'last' or 'mean'")
    zero = F.transform(F.element_at(col(states), 1), lambda _x: F.lit(0.0))
    total = F.aggregate(col(states), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return let(F.size(col(states)), lambda n: F.transform(total, lambda x: x / n))

"""Contiguous blocks of an order: running sums and ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.text import let
from heddle.sources.shared import materialise

#: Rows that a block of an order is meant to hold, blocks at most, keys looked at for each bound, and letters of a text in a bound.
BLOCK_ROWS, MOST_BLOCKS, PICKED, LETTERS = 20_000, 4096, 16, 64


def _literal(value: object, kind: T.DataType) -> str:
    """A value as SQL."""
    if value is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    if isinstance(kind, T.StructType):
        return "named_struct(" + ", ".join(f"'{f.name}', {_literal(value[f.name], f.dataType)}" for f in kind) + ")"
    if isinstance(kind, T.ArrayType):
        return f"CAST(array({', '.join(_literal(v, kind.elementType) for v in value)}) AS {kind.simpleString()})"
    if isinstance(kind, T.BinaryType):
        return f"X'{bytes(value).hex()}'"
    shown = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{shown}' AS {kind.simpleString()})"


def bounds_of(keys: DataFrame, blocks: int) -> list[str]:
    """Keys, as SQL, at equal places among the PICKED * ``blocks`` ones with the smallest hashes: the same on every evaluation.

    They only balance the blocks; no result depends on them. Their number is bounded by MOST_BLOCKS, and texts are cut.
    """
    names = keys.columns
    short = keys.select(*[F.left(n, F.lit(LETTERS)).alias(n) if f.dataType == T.StringType() else F.col(n) for n, f in zip(names, keys.schema, strict=True)])
    picked = short.orderBy(F.xxhash64(*names), *names).limit(PICKED * blocks).orderBy(*names).collect()
    chosen = sorted({k * len(picked) // blocks for k in range(1, blocks)}) if picked else []
    kind = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, short.schema, strict=True)])
    return [_literal(picked[k], kind) for k in chosen]


def block_of(key: Column, bounds: list[str]) -> Column:
    """How many of the ascending ``bounds`` are not over ``key``, found in two steps; the key is bound, not repeated."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    up_to = lambda some, k: F.size(F.filter(some, lambda b: b <= k))
    steps, every = (F.expr(f"array({', '.join(some)})") for some in (bounds[::width], bounds))

    def inside(k: Column, step: Column) -> Column:
        first = F.greatest(step - 1, F.lit(0)) * width
        return F.when(step == 0, 0).otherwise(first + up_to(F.slice(every, first + 1, F.lit(width)), k))

    return let(key, lambda k: let(up_to(steps, k), lambda step: inside(k, step)))


def running_before(df: DataFrame, value: Column, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one, per group of ``by``; nulls of the order come first.

    The rows are written once with their keys, so that whatever ``df`` computes is computed once; the bounds and the totals of
    the blocks read only the keys. Then a task sorts one block of a group.
    """
    keys, names = by or [], [f"_o{k}" for k in range(len(order))]
    written = materialise(df.withColumns({**dict(zip(names, order, strict=True)), "_value": value.cast("long")}), "blocks")
    blocks = min(MOST_BLOCKS, -(-written.count() // BLOCK_ROWS))
    bounds = bounds_of(written.select(*names), blocks) if blocks > 1 else []
    placed = written.withColumn("_block", block_of(F.struct(*names), bounds))
    totals = placed.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    # Without groups there is one base a block.
    joined = summed.join(F.broadcast(bases), "_block") if not keys else summed.join(bases, [*keys, "_block"])
    return joined.withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_block", "_value", "_in", "_base", *names)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order``, from 1."""
    return running_before(df, F.lit(1), order, name).withColumn(name, F.col(name) + 1)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of ``order``, however many, without one task that holds them."""
    return running_before(df, F.lit(1), order, "_before").where(F.col("_before") < n).drop("_before")

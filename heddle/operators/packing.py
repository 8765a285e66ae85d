"""Fixed-length training sequences from token lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.blocks import running_before


def with_specials(ids: Column | str, bos: int = 1, eos: int = 2) -> Column:
    """Begin and end ids around a token list."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array(F.lit(bos)), c.cast("array<int>"), F.array(F.lit(eos)))


def long_enough(ids: str, least: int = 2) -> Column:
    return F.size(ids) >= least


def truncate(ids: str, length: int) -> Column:
    """The first ``length`` + 1 ids."""
    return F.slice(F.col(ids), 1, length + 1)


def pack(docs: DataFrame, ids: str, order: list[str], length: int, pad: int = 0, ignore: int = -100, by: list[str] | None = None) -> DataFrame:
    """Chunks of ``length`` + 1 consecutive tokens of the documents in ``order``: chunk, input_ids, labels.

    Chunks do not overlap; inputs are all but the last token of a chunk and labels all but the first. The
    last chunk is kept if it has over one token: it is padded, and its labels equal to the pad id are
    ``ignore`` (a genuine pad id in it too). With ``by`` each group is a stream of its own.

    Offsets are a running sum over blocks of the order, whatever its types; each document is then cut at chunk borders into
    slices, so a chunk gathers at most ``length`` + 1 slices and no stream is collected. Null and empty
    lists add nothing.
    """
    keys, width = by or [], length + 1
    sized = docs.where(F.size(ids) > 0).withColumn("_n", F.size(ids))
    placed = running_before(sized, F.col("_n"), [F.col(c) for c in order], "_at", keys)
    first, last = F.floor(F.col("_at") / width), F.floor((F.col("_at") + F.col("_n") - 1) / width)
    cut = placed.select(*keys, "_at", "_n", F.col(ids).alias("_ids"), F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("chunk") * width - F.col("_at"), F.lit(0))
    high = F.least((F.col("chunk") + 1) * width - F.col("_at"), F.col("_n"))
    slices = cut.select(*keys, "chunk", "_at", F.slice("_ids", (low + 1).cast("int"), (high - low).cast("int")).alias("_s"))
    chunks = slices.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_c"))
    tokens = chunks.withColumn("_t", F.flatten(F.transform("_c", lambda x: x["_s"]))).where(F.size("_t") > 1)
    tail = F.size("_t") < width
    full = F.concat(F.col("_t"), F.array_repeat(F.lit(pad), width - F.size("_t")))
    labels = F.slice(full, 2, length)
    masked = F.when(tail, F.transform(labels, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))).otherwise(labels)
    return tokens.select(
        *keys, "chunk", F.slice(full, 1, length).cast("array<bigint>").alias("input_ids"), masked.cast("array<bigint>").alias("labels")
    )

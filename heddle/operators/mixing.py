"""Unions and ratio-controlled mixing of two corpora, with reproducible sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.blocks import first_rows, ranked


def seeded_key(ids: Column | str, seed: int) -> Column:
    """A portable pseudo-random key of an id: MD5 of id, colon, seed, in hex."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def seeded_shuffle(df: DataFrame, ids: str, seed: int) -> DataFrame:
    return df.orderBy(seeded_key(ids, seed), ids)


def shuffled(df: DataFrame, ids: str, seed: int, name: str) -> DataFrame:
    """``df`` with each row's place, from 1, in the order that :func:`seeded_shuffle` gives."""
    return ranked(df, [seeded_key(ids, seed), F.col(ids)], name)


def sample_exact(df: DataFrame, ids: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: those with the least seeded keys; all of them if there are fewer."""
    return first_rows(df, [seeded_key(ids, seed), F.col(ids)], n)


def mix_counts(corpus: int, distilled: int, ratio: float) -> tuple[int, int]:
    """Rows to take of each side for a share ``ratio`` of distilled rows."""
    if corpus == 0 and distilled == 0:
        raise ValueError("both sides of the mix are empty")
    if corpus == 0 or distilled == 0:
        return corpus, distilled
    want = int(corpus * ratio / max(1e-5, 1 - ratio))
    if want <= distilled:
        return corpus, want
    return min(corpus, int(distilled * (1 - ratio) / max(1e-5, ratio))), distilled


def mix(corpus: DataFrame, distilled: DataFrame, ids: str, ratio: float = 0.20, seed: int = 42) -> DataFrame:
    """The mix with a column ``origin``: one side whole, the other sampled without replacement.

    Only the two counts come to the driver. Rows are in no order; :func:`seeded_shuffle` gives one.
    """
    n_corpus, n_distilled = corpus.count(), distilled.count()
    take_corpus, take_distilled = mix_counts(n_corpus, n_distilled, ratio)
    parts = []
    for name, side, n, take in (("corpus", corpus, n_corpus, take_corpus), ("distilled", distilled, n_distilled, take_distilled)):
        parts.append((side if take == n else sample_exact(side, ids, take, seed)).withColumn("origin", F.lit(name)))
    return parts[0].unionByName(parts[1])


def mix_stats(mixed: DataFrame) -> DataFrame:
    """total, corpus_count, distilled_count, actual_distill_ratio."""
    counts = mixed.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("origin") == "corpus").alias("corpus_count"),
        F.count_if(F.col("origin") == "distilled").alias("distilled_count"),
    )
    return counts.withColumn("actual_distill_ratio", F.col("distilled_count") / F.greatest(F.lit(1), F.col("total")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def label_union(predefined: Column | str, extra: Column | str) -> Column:
    """Distinct labels of two arrays in order of first occurrence."""
    both = [F.col(c) if isinstance(c, str) else c for c in (predefined, extra)]
    return F.array_distinct(F.concat(both[0], F.coalesce(both[1], F.array().cast("array<string>"))))


def curriculum_rank(df: DataFrame, score: str, order: list[str], reverse: bool = False) -> DataFrame:
    """``df`` with ``curriculum_rank`` from 1; ties keep the input order in either direction.

    Ranks are counts before a row, summed over blocks of the order: however many rows share a score, no task sorts them all.
    Null scores come first, in reverse last.
    """
    own = F.col(score)
    key = [own.isNull(), -own] if reverse else [own]
    return ranked(df, [*key, *map(F.col, order)], "curriculum_rank")

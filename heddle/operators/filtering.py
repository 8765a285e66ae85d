"""The corpus filter: one reason per row, exact dedup last, counters per reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import quality as q
from heddle.functions.text import is_blank

#: Reasons in the order of their tests; a row is charged to the first that it fails.
REASONS = ("malformed", "lang", "license", "quality", "score", "dedup", "accepted")

#: Shares that a group is dealt into before its first rows are chosen.
SHARES = 64


def path_of(df: DataFrame) -> Column:
    """The path, else the repository, else the empty text; absent columns count as null."""
    return F.coalesce(*[F.col(c) for c in ("path", "repo") if c in df.columns], F.lit(""))


def seen_before(df: DataFrame, seen: DataFrame | None, name: str = "hash") -> DataFrame:
    """``df`` with ``_seen``: whether an earlier run has kept its hash. The table of hashes is joined, never collected."""
    if seen is None:
        return df.withColumn("_seen", F.lit(False))
    known = seen.select(F.col(name).alias("_known")).distinct()
    return df.join(known, F.col("_hash") == F.col("_known"), "left").withColumn("_seen", F.col("_known").isNotNull()).drop("_known")


def with_reasons(
    df: DataFrame,
    order: list[str],
    *,
    lang: str = "lang",
    license: str = "license",
    content: str = "content",
    languages: tuple[str, ...] = q.LANGUAGES,
    licenses: tuple[str, ...] = q.LICENSES,
    min_score: float = 0.0,
    seen: DataFrame | None = None,
    malformed: str | None = None,
    exact_round: bool = False,
) -> DataFrame:
    """``df`` with ``quality_score``, ``content_hash`` and ``reason``.

    Tests run in the order of REASONS; the score is tested only when ``min_score`` is over 0. Dedup comes
    last: of the rows that pass everything else, the first of each hash in ``order`` is accepted, unless an
    earlier run (``seen``, a table of hashes) has it. Copies are ranked twice: in SHARES shares of a hash, dealt by the
    order, and then the first of each share, so a mass of copies of one text is sorted by many tasks. Columns that
    the caller does not use, such as the text when only reasons are counted, are pruned below these exchanges.
    """
    early = (
        F.when(F.col(malformed) if malformed else F.lit(False), F.lit("malformed"))
        .when(~q.is_target_language(lang, languages), F.lit("lang"))
        .when(~q.is_permissive_license(license, licenses), F.lit("license"))
        .when(~q.passes_quality_heuristics(content), F.lit("quality"))
    )
    scored = df.withColumn("_early", early).withColumn(
        "quality_score", F.when(F.col("_early").isNull(), q.textbook_quality(content, path_of(df), exact_round))
    )
    if min_score > 0.0:
        scored = scored.withColumn("_early", F.coalesce("_early", F.when(F.col("quality_score") < min_score, F.lit("score"))))
    hashed = seen_before(scored.withColumn("_hash", F.when(F.col("_early").isNull(), q.content_hash(content))), seen)
    # Rows that failed earlier have no hash; a salt spreads them, and those that are not first of a share: their rank is not used.
    own = F.xxhash64(*[F.col(c) for c in order])
    share = Window.partitionBy("_hash", F.when(F.col("_hash").isNull(), own).otherwise(F.pmod(own, F.lit(SHARES)))).orderBy(*order)
    shared = hashed.withColumn("_n", F.row_number().over(share))
    salt = F.when(F.col("_hash").isNull() | (F.col("_n") > 1), own)
    first = F.row_number().over(Window.partitionBy("_hash", salt).orderBy(*order))
    copy = F.col("_seen") | (F.col("_n") > 1) | (first > 1)
    reason = F.coalesce(F.col("_early"), F.when(copy, F.lit("dedup")), F.lit("accepted"))
    return shared.withColumn("reason", reason).withColumnRenamed("_hash", "content_hash").drop("_early", "_seen", "_n")


def accepted(flagged: DataFrame, *, lang: str = "lang", license: str = "license", content: str = "content") -> DataFrame:
    """The filtered documents in their four output columns."""
    kept = flagged.where(F.col("reason") == "accepted")
    return kept.select(F.col(content).alias("content"), F.col(lang).alias("lang"), F.col(license).alias("license"), "quality_score")


def counters() -> list[Column]:
    """The total, the rows that each test removed, and the accepted ones, as aggregates."""
    count = lambda r: F.count_if(F.col("reason") == r)
    removed = [count(r).alias(f"{r}_filtered") for r in ("lang", "license", "quality", "score", "dedup")]
    return [F.count(F.lit(1)).alias("total"), *removed, count("accepted").alias("accepted")]


def filter_stats(flagged: DataFrame) -> DataFrame:
    """One row of :func:`counters`."""
    return flagged.agg(*counters())


def sum_stats(stats: DataFrame) -> DataFrame:
    """Counters of several runs in one row."""
    return stats.agg(*[F.sum(c).alias(c) for c in stats.columns])


def exact_dedup(df: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first row of each content in ``order``; rows with null content stay.

    The rank is limited to one alone, which Spark applies before the exchange as well, so of a mass of copies each task
    sends one row. Null rows are told apart by their position, so each is the first of its own.
    """
    ranked = df.withColumn("_hash", q.content_hash(content))
    ranked = ranked.withColumn("_own", F.when(F.col("_hash").isNull(), F.monotonically_increasing_id()))
    w = Window.partitionBy("_hash", "_own").orderBy(*order)
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_hash", "_own", "_n")


def non_blank(df: DataFrame, content: str) -> DataFrame:
    return df.where(~is_blank(content))


def limit_per_group(df: DataFrame, group: str, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Each of SHARES shares of a group, dealt by a hash of the order, passes on its own first ``n`` rows, so a group that
    holds most of the table is sorted by many tasks and the last one sees the rows that can still win.
    """
    share = F.pmod(F.xxhash64(*order), F.lit(SHARES))
    first = Window.partitionBy(group, "_share").orderBy(*order)
    few = df.withColumn("_share", share).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_share", "_n")
    w = Window.partitionBy(group).orderBy(*order)
    return few.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def limit_per_file(df: DataFrame, file: str, order: list[str], max_records: int | None) -> DataFrame:
    """The first ``max_records`` rows of each file; none or 0 is no limit."""
    return df if not max_records else limit_per_group(df, file, max_records, order)

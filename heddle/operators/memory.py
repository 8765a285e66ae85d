"""A vector memory as a table: append, evict, retrieve, persist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.vectors import dot, l2_normalise
from heddle.operators import nearest
from heddle.operators.blocks import first_rows, ranked

SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("key", T.ArrayType(T.DoubleType()), False),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.DoubleType()),
    ]
)
#: Entries beyond which an exact scan is slow on one machine; a table has no such bound.
RECOMMENDED = 50_000


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def numbered(rows: DataFrame, dim: int, last: int, *, key: str = "embedding", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Rows as entries of a memory whose last index is ``last``, in ``order``; numbers are counts by blocks of that order."""
    right = F.when(F.size(key) == dim, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, not "), F.size(key))))
    placed = ranked(rows, [F.col(c) for c in order or [text]], "_n")
    return placed.select(
        (F.col("_n") + last).cast("long").alias("idx"),
        l2_normalise(right).alias("key"),
        F.col(text).alias("text"),
        (F.col("ts") if "ts" in rows.columns else F.unix_micros(F.current_timestamp()) / 1e6).cast("double").alias("ts"),
    )


def append(memory: DataFrame, rows: DataFrame, dim: int, max_entries: int | None = None, *, key: str = "embedding", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``memory`` with the rows of another table after it, in ``order``; the oldest go beyond ``max_entries``.

    Keys become unit vectors. A row of another dimension fails the query when it is read.
    """
    last = memory.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0]
    new = numbered(rows, dim, last, key=key, text=text, order=order)
    both = memory.select(*SCHEMA.names).unionByName(new)
    return both if max_entries is None else evict(both, max_entries)


def evict(memory: DataFrame, max_entries: int, order: str = "idx") -> DataFrame:
    """The newest ``max_entries`` rows by insertion order, however many."""
    return first_rows(memory, [-F.col(order)], max_entries)


def evicted_count(memory: DataFrame, max_entries: int) -> int:
    return max(0, memory.count() - max_entries)


def retrieve(memory: DataFrame, query: list[float], k: int = 3, threshold: float = 0.0, *, key: str = "key", text: str = "text", idx: str = "idx") -> DataFrame:
    """The ``k`` most similar rows at or over a cosine threshold: text, similarity, index; ties by index.

    An exact scan; each task keeps its own best ``k`` rows.
    """
    target = l2_normalise(F.array(*map(F.lit, map(float, query))))
    scored = memory.select(F.col(text).alias("text"), dot(l2_normalise(key), target).alias("similarity"), F.col(idx).alias("index"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.col("similarity").desc(), "index").limit(k)


def retrieve_each(
    memory: DataFrame, queries: DataFrame, k: int = 3, threshold: float = 0.0, *, key: str = "key", idx: str = "idx", decimals: int | None = None
) -> DataFrame:
    """The ``k`` most similar rows for each query: query, index, similarity, rank; ties by index.

    ``queries`` has the same columns ``key`` and ``idx``. Exact, by way of :mod:`heddle.operators.nearest`: a query meets only the
    cells of vectors that can hold one of its best. With ``decimals`` similarities are rounded before they are ordered. Rows
    whose vector is null or has another length than most are left out.
    """
    index = nearest.build(memory, key=key, idx=idx)
    if index is None:
        kind = memory.schema[idx].dataType.simpleString()
        return memory.sparkSession.createDataFrame([], f"query {kind}, index {kind}, similarity double, rank int")
    return index.search(queries, k, threshold, key=key, idx=idx, decimals=decimals)


def save(memory: DataFrame, path: str) -> None:
    memory.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def load_or_create(spark: SparkSession, path: str) -> DataFrame:
    """The saved memory, or an empty one where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return load(spark, path)
    return empty(spark)

"""A vector memory on disk that grows by appending: one folder of Parquet an append, named by the entries that it holds.

Folders are ``generation=G/first=A/upto=B`` and hold the entries A to B. One counts once Spark has set its success mark, so an
append that was cut off leaves nothing that a reader sees, and coming again it writes its folder anew. The names alone say which
entry is the last and which folders an eviction leaves out: an append costs what its own rows cost. Compaction writes the entries
that are still wanted as one folder of the next generation; readers take the latest one that has a finished folder.

One process appends at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import memory

_NAME = re.compile(r"generation=(\d+)/first=(\d+)/upto=(\d+)$")


@dataclass(frozen=True, order=True)
class Segment:
    generation: int
    first: int
    upto: int

    def folder(self, path: str) -> str:
        return f"{path.rstrip('/')}/generation={self.generation}/first={self.first}/upto={self.upto}"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """The finished segments of the latest generation that has any, oldest entries first."""
    system, target = _files(spark, f"{path.rstrip('/')}/generation=*/first=*/upto=*/_SUCCESS")
    names = [f.getPath().getParent().toString() for f in system.globStatus(target) or []]
    found = sorted(Segment(*map(int, _NAME.search(n).groups())) for n in names)
    return [s for s in found if s.generation == found[-1].generation]


def append(rows: DataFrame, path: str, dim: int, *, key: str = "embedding", text: str = "text", order: list[str] | None = None) -> Segment | None:
    """The rows in ``order`` as the newest entries of the memory at ``path``; None where there are no rows.

    Keys become unit vectors; a row of another dimension fails the append, and nothing of it is seen.
    """
    spark = rows.sparkSession
    known = segments(spark, path)
    last, generation = (known[-1].upto, known[-1].generation) if known else (-1, 0)
    new = memory.numbered(rows, dim, last, key=key, text=text, order=order)
    n = new.agg(F.count("*").alias("n")).first()["n"]  # counts the written keys only
    if not n:
        return None
    segment = Segment(generation, last + 1, last + n)
    new.write.mode("overwrite").parquet(segment.folder(path))
    return segment


def load(spark: SparkSession, path: str, max_entries: int | None = None) -> DataFrame:
    """The newest ``max_entries`` entries, or all; folders of older ones are not opened. Without a memory an empty one."""
    known = segments(spark, path)
    least = 0 if max_entries is None or not known else known[-1].upto - max_entries + 1
    folders = [s.folder(path) for s in known if s.upto >= least]
    if not folders:
        return memory.empty(spark)
    return spark.read.schema(memory.SCHEMA).parquet(*folders).where(F.col("idx") >= least)


def compact(spark: SparkSession, path: str, max_entries: int | None = None) -> Segment | None:
    """One folder of the entries that :func:`load` gives; the folders that it replaces go once it is finished."""
    known = segments(spark, path)
    if not known:
        return None
    rows, last = load(spark, path, max_entries), known[-1]
    first = max(known[0].first, 0 if max_entries is None else last.upto - max_entries + 1)
    whole = Segment(last.generation + 1, first, last.upto)
    parts = max(1, -(-(last.upto - first + 1) // memory.RECOMMENDED))
    rows.repartitionByRange(parts, "idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(whole.folder(path))
    for generation in range(whole.generation):
        system, target = _files(spark, f"{path.rstrip('/')}/generation={generation}")
        if system.exists(target):
            system.delete(target, True)
    return whole

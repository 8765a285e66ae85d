"""Written tables and files in the folder that all executors share.

Lineage is cut with tables written to ``spark.checkpoint.dir``; only where that setting is absent
(tests, a laptop) does a folder under the system's temporary directory take its place. Tables are
removed when the driver exits, or earlier by :func:`clear`, because a lazily returned result may still
read them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a task holds of a table that it writes.
ROW_GROUP = 32 << 20

_written: list[tuple[SparkSession, str]] = []
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; set here only where it is unset and all executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/heddle-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def passing() -> Iterator[None]:
    """Tables that are written inside and are not lasting go when the block ends: nothing outside may read them."""
    _passing.append([])
    try:
        yield
    finally:
        drop(_passing.pop())


def materialise(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table. In a :func:`passing` block a table that is to outlive it is ``lasting``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if _passing and not lasting:
        _passing[-1].append(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written() -> list[str]:
    """Folders of the tables that are still there."""
    return [path for _, path in _written]


def drop(paths: Iterable[str]) -> None:
    """Delete written tables that nothing reads any more."""
    gone = set(paths)
    for spark, path in [w for w in _written if w[1] in gone]:
        _delete(spark, path)
        _written.remove((spark, path))


def clear() -> None:
    """Delete every table written so far."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: nothing is left that could delete the folder
            return


atexit.register(clear)

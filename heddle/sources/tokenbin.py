"""Headerless streams of little-endian int32 token ids as a data source: one file, written and read by byte ranges.

Register with ``spark.dataSource.register(TokenStream)``. A write takes rows (at long, ids array<int>), ``at`` being the number of
ids before the row in the stream. Each task puts its rows at their places in a file beside the target; the file takes the target's
name only after all tasks have said what they wrote and the sum is the stream's length, and goes if a task fails for good. A task
that runs again writes the same bytes to the same places. A folder that all executors mount is needed for that; reading works on
every file system that Arrow opens.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from heddle.operators.blocks import running_before

ID = np.dtype("<i4")
#: Bytes of a file that one task reads, and of it at once.
SPLIT, READ = 128 << 20, 4 << 20


def _local(path: str) -> str:
    """The path of a mounted folder; other stores cannot write at a place inside a file."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"a stream is written to a mounted folder, not to {at.scheme}")
    return at.path


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Ids ``low`` to before ``high`` of a file."""

    file: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    ids: int


class TokenStream(DataSource):
    """Options: ``path``; reading ``window`` (ids a row, 2048) and ``split`` (bytes a task); writing ``ids`` (the stream's length)."""

    @classmethod
    def name(cls) -> str:
        return "tokenstream"

    def schema(self) -> str:
        return "file string, at long, ids array<int>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.window = int(options.get("window", 2048))
        self.split = int(options.get("split", SPLIT))
        if self.window < 1:
            raise ValueError("a window holds one id at least")

    def partitions(self) -> list[Range]:
        """Ranges of whole windows; an odd end of under four bytes is not an id."""
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path))
            files = sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".bin")), key=lambda f: f.path)
        else:
            files = [info]
        step = max(1, self.split // ID.itemsize // self.window) * self.window
        return [Range(f.path, low, min(low + step, f.size // ID.itemsize)) for f in files for low in range(0, f.size // ID.itemsize, step)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _opened(self.path)
        step = max(1, READ // ID.itemsize // self.window) * self.window
        with system.open_input_file(partition.file) as f:
            for low in range(partition.low, partition.high, step):
                high = min(low + step, partition.high)
                ids = np.frombuffer(f.read_at((high - low) * ID.itemsize, low * ID.itemsize), ID)
                starts = np.arange(0, high - low, self.window)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, high - low).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(starts), pa.string()), pa.array(low + starts), lists], ["file", "at", "ids"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target, self.ids = _local(options["path"]), int(options["ids"])
        if os.path.exists(self.target) and not overwrite:
            raise FileExistsError(self.target)
        os.makedirs(os.path.dirname(self.target) or ".", exist_ok=True)
        self.file = f"{self.target}.{uuid.uuid4().hex}.part"
        with open(self.file, "wb") as f:
            f.truncate(self.ids * ID.itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = 0
        with open(self.file, "r+b") as f:
            for batch in iterator:
                lists = batch.column("ids").cast(pa.list_(pa.int32()))
                flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(ID, copy=False), lists.offsets.to_numpy()
                for at, low, high in zip(batch.column("at").to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                    f.seek(at * ID.itemsize)
                    f.write(flat[low:high].tobytes())
                    done += high - low
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        done = sum(m.ids for m in messages if m is not None)
        if done != self.ids:
            self.abort(messages)
            raise ValueError(f"{done} ids written of a stream of {self.ids}")
        os.replace(self.file, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.file):
            os.remove(self.file)


def write_stream(df: DataFrame, ids: str, order: list[str], path: str, overwrite: bool = False) -> int:
    """One file with the ids of all rows in ``order``, one after the other; the number of ids. Null and empty lists add nothing.

    Places are running sums by blocks of the order, so no task sees the whole table.
    """
    df.sparkSession.dataSource.register(TokenStream)
    rows = df.where(F.size(ids) > 0).select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(order)], F.col(ids).cast("array<int>").alias("ids"), F.size(ids).alias("_n"))
    placed = running_before(rows, F.col("_n"), [F.col(f"_k{k}") for k in range(len(order))], "at")
    total = placed.agg(F.coalesce(F.max(F.col("at") + F.col("_n")), F.lit(0)).alias("n")).first()["n"]  # reads no ids
    placed.select("at", "ids").write.format("tokenstream").option("ids", total).mode("overwrite" if overwrite else "append").save(path)
    return total


def read_stream(spark: SparkSession, path: str, window: int = 2048, split: int = SPLIT) -> DataFrame:
    """Windows of ``window`` ids of a stream, or of all ``.bin`` files of a folder: file, at (ids before it), ids."""
    spark.dataSource.register(TokenStream)
    return spark.read.format("tokenstream").options(window=window, split=split).load(path)

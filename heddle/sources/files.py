"""Sources and sinks: JSON lines, source trees, raw lines, token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.text import is_blank, strip

# Fixed value: suffixes of source files.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".py", ".vue", ".svelte", ".json", ".yaml", ".yml", ".md", ".mdx", ".html", ".css", ".scss")
#: A raw document; unknown fields are dropped, absent ones null.
DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("content", "lang", "license", "repo", "path")])
FILTERED = T.StructType([*DOCUMENT.fields[:3], T.StructField("quality_score", T.DoubleType())])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, glob: str = "*.jsonl") -> DataFrame:
    """Documents of JSON lines with ``malformed``, ``file`` and ``line_no`` (an order of each file's lines).

    Lines that are not a JSON object are kept and marked; their fields are null. Files directly under
    ``path`` that match ``glob`` are read; bytes that are not UTF-8 become replacement characters.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    numbered = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    good = F.coalesce(is_object, F.lit(False))
    out = numbered.where(~is_blank("value")).withColumn("_ok", good).withColumn("_d", F.when(F.col("_ok"), parsed))
    return out.select("_d.*", (~F.col("_ok")).alias("malformed"), "file", F.struct("_b", "_m").alias("line_no"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines of all columns; other letters than ASCII are kept. ``mode='ignore'`` keeps an existing output."""
    df.write.mode(mode).json(path)


def write_files(df: DataFrame, name: str, content: str, path: str) -> None:
    """One file a row under ``path``, a folder that all executors share, by its relative name; a file that is there is replaced.

    A task that runs again writes the same files. Names that leave the folder fail the write.
    """
    root = path.rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        made = set()
        for frame in batches:
            for own, text in zip(frame["name"], frame["content"], strict=True):
                if own.startswith("/") or ".." in own.split("/"):
                    raise ValueError(f"not a name inside the folder: {own}")
                folder = f"{at}/{own}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{at}/{own}") as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"n": [len(frame)]})

    df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def read_source_tree(spark: SparkSession, dirs: list[str], max_files: int | None = None) -> DataFrame:
    """Whole source files under ``dirs``: path, content. Blank files are skipped; missing folders too."""
    found = [d for d in dirs if exists(spark, d)]
    if not found:
        return spark.createDataFrame([], "path string, content string")
    files = spark.read.text(found, wholetext=True, recursiveFileLookup=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    suffix = F.lit(False)
    for e in EXTENSIONS:
        suffix = suffix | F.endswith("path", F.lit(e))
    kept = named.where(suffix & ~is_blank("content"))
    return kept.orderBy("path").limit(max_files) if max_files else kept


def read_raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stripped lines that are not blank, unparsed: line. Missing paths are skipped."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "line string")
    return spark.read.text(found).select(strip("value").alias("line")).where(F.col("line") != "")


def read_ids_jsonl(spark: SparkSession, path: str, bos: int | None = 1, eos: int | None = 2) -> DataFrame:
    """Pre-tokenized lines (input_ids); empty ones are skipped, begin and end ids added unless None."""
    if not path.rstrip("/").endswith((".json", ".jsonl")):
        raise ValueError(f"not a .json or .jsonl path: {path}")
    rows = spark.read.schema("input_ids array<int>").json(path).where(F.size("input_ids") > 0)
    parts: list[Column] = [F.array(F.lit(bos))] if bos is not None else []
    parts += [F.col("input_ids")] + ([F.array(F.lit(eos))] if eos is not None else [])
    return rows.select(F.concat(*parts).alias("input_ids"))


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"data": [np.asarray(x, "<i4").tobytes() for x in frame["ids"]]})


def write_token_stream(df: DataFrame, ids: str, order: list[str], path: str) -> None:
    """A table of little-endian int32 blobs, one a document, in ``order``; their concatenation is the stream."""
    ranged = df.where(F.col(ids).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.col(ids).alias("ids")).mapInPandas(_flat, "data binary").write.parquet(path)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"file": frame["path"], "ids": [np.frombuffer(x, "<i4").tolist() for x in frame["content"]]})


def read_token_files(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """Headerless int32 files: file, ids. A whole file is one document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(_unpack, "file string, ids array<int>")


def random_tokens(spark: SparkSession, n: int = 50_000, vocabulary: int = 256, seed: int = 42) -> DataFrame:
    """Seeded ids from 4 up to the vocabulary's size: position, token."""
    return spark.range(n).select(F.col("id").alias("position"), (F.floor(F.rand(seed) * (vocabulary - 4)) + 4).cast("int").alias("token"))


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless the output is there; whether it was written."""
    if exists(df.sparkSession, path):
        return False
    df.write.parquet(path)
    return True

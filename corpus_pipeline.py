"""Five stages from raw documents to token ids, each on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, decontaminate, nearcopies, quality, substrings
from heddle.llm.queries import table, vocabulary
from heddle.sources.shared import drop, materialise, written

VOCABULARY = "byte_bpe_50k.json"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages have written and their results may still read.
_left: set[str] = set()


def stage(function: Stage) -> Stage:
    """A stage that first deletes what the stages before it have left, but for what its own input reads.

    A stage's result is written and read again before the next one starts, so the tables behind it are done with. Of two
    results that are both still lazy only the later one may be read.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {folder for file in docs.inputFiles() for folder in file.split("/")}
        done = {path for path in _left if path.rpartition("/")[2] not in read}
        drop(done)
        _left.difference_update(done)
        before = set(written())
        out = function(spark, docs, sf_dir)
        _left.update(path for path in written() if path not in before)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the fixed limits or the robust outlier test reject."""
    return quality.keep_good(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group that 5-word similarity of 0.8 or more links."""
    return nearcopies.keep_one(docs)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 200 bytes or more that repeat; n_chars follows the text."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents that are nothing else go. n_chars follows the text."""
    cut = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text again."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(VOCABULARY), exact="exact")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The stages are not SQL: the robust estimates, the fingerprint groups and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again; the last stays lazy."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k + 1}")
    return docs

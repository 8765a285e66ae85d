"""The corpus pipeline end to end: filter folders of JSON lines, tokenize, validate. Each step writes a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heddle.functions import quality as q
from heddle.operators import estimates, filtering, packing, tokenizer
from heddle.sources import files


def filter_all(spark: SparkSession, raw: str, out: str, *, min_score: float = 0.0, max_records: int | None = None, seen: DataFrame | None = None,
               languages: tuple[str, ...] = q.LANGUAGES, licenses: tuple[str, ...] = q.LICENSES, glob: str = "*.jsonl") -> DataFrame:
    """Filter every JSON-lines file under ``raw`` with one dedup over all of them; the files' order is their names'.

    Writes the accepted documents (with their hash) to ``out`` and returns the counters, which are observed in the
    write itself: the files are read, scored and deduplicated once. Hashes of earlier outputs may be given as ``seen``.
    """
    docs = filtering.limit_per_file(files.read_jsonl(spark, raw, glob=glob), "file", ["line_no"], max_records)
    flagged = filtering.with_reasons(
        docs, ["file", "line_no"], min_score=min_score, malformed="malformed", seen=seen, languages=languages, licenses=licenses
    )
    seen_by = Observation("filter")
    kept = flagged.observe(seen_by, *filtering.counters()).where("reason = 'accepted'").select("content", "lang", "license", "quality_score", F.col("content_hash").alias("hash"))
    kept.write.mode("overwrite").parquet(out)
    counts = seen_by.get
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def tokenize_all(spark: SparkSession, filtered: str, out: str, vocabulary: str, bos: int = 1, eos: int = 2) -> bool:
    """Token lists with begin and end ids of the filtered documents; an existing output is left alone."""
    docs = spark.read.parquet(filtered)
    ids = packing.with_specials(tokenizer.encode("content", vocabulary), bos, eos)
    return files.write_once(docs.select("hash", ids.alias("ids")), out)


def validate_tokens(spark: SparkSession, tokens: str, target: int = estimates.TOKEN_TARGET) -> DataFrame:
    return estimates.token_sufficiency(spark.read.parquet(tokens), "ids", target)


def run_steps(steps: list[tuple[str, object]]) -> list[str]:
    """Run (name, function) steps in order; the first failure stops them. Returns the names done."""
    done = []
    for name, step in steps:
        step()
        done.append(name)
    return done

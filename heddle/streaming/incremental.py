"""Streaming forms: incremental filtering with dedup, a bounded memory, and event windows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import quality as q
from heddle.operators import memory as m
from heddle.operators.filtering import path_of


def filter_stream(docs: DataFrame, *, content: str = "content", lang: str = "lang", license: str = "license", min_score: float = 0.0,
                  languages: tuple[str, ...] = q.LANGUAGES, licenses: tuple[str, ...] = q.LICENSES) -> DataFrame:
    """Accepted documents of a stream, each content once: state is one hash a document, in the state store.

    Without a watermark the state grows with the distinct contents, as exact dedup over all time asks.
    """
    kept = docs.where(q.is_target_language(lang, languages) & q.is_permissive_license(license, licenses) & q.passes_quality_heuristics(content))
    scored = kept.withColumn("quality_score", q.textbook_quality(content, path_of(docs))).where(F.col("quality_score") >= min_score)
    return scored.withColumn("content_hash", q.content_hash(content)).dropDuplicates(["content_hash"])


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Whole versions of a memory by their epoch; a version that was cut off has no success mark."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []
    folders = [f.getPath().getParent() for f in found]
    return {int(f.getName().partition("=")[2]): f.toString() for f in folders}


def recall(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a memory that :func:`remember` writes; an empty one where there is none."""
    known = _versions(spark, path)
    return m.load(spark, known[max(known)]) if known else m.empty(spark)


def remember(stream: DataFrame, path: str, dim: int, max_entries: int, *, key: str = "embedding", text: str = "text", order: list[str] | None = None):
    """A writer that appends each micro-batch to the memory at ``path`` and evicts the oldest entries; start it yourself.

    Each epoch writes a version of its own from the one before. An epoch that comes again after a crash finds its version
    and does nothing, or writes it anew if it was cut off; versions older than the one before go.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = _versions(spark, path)
        if epoch in known:
            return
        earlier = max((e for e in known if e < epoch), default=None)
        base = m.empty(spark) if earlier is None else m.load(spark, known[earlier])
        m.save(m.append(base, batch, dim, max_entries, key=key, text=text, order=order), f"{path}/epoch={epoch}")
        for old in (known[e] for e in known if earlier is not None and e < earlier):
            target = spark._jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return stream.writeStream.foreachBatch(each)


def windowed_counts(events: DataFrame, ts: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark; the same expression runs on a batch."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, width), group).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), group, "n"
    )

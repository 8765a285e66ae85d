"""Contiguous, byte-balanced shards from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.shared import materialise

#: Bytes that a record's framing takes beside its text.
FRAME_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal ``docs`` into ``n_shards`` contiguous runs of ``key`` order with near-equal byte sizes.

    A range exchange of narrow rows (key, size, checksum) fixes the global order. Each range
    partition yields one total; a prefix sum over those few totals gives every partition its base,
    and a running sum inside the partition gives every row its global byte offset. A row belongs to
    the shard in whose equal slice of the total its midpoint lies, so each cut is the row boundary
    nearest to its target and a shard misses its target by less than the largest row.

    Null texts have no bytes (size 8, checksum 0). Null keys sort first. Rows that tie on the key are
    ordered by size, checksum and input position, so repeated rows and one key with a third of all
    rows are still cut apart. An empty table gives an empty result. Other columns are not read.

    Returns: key, size, text_crc32, law, shard, slot (position in its shard), grown_shard (null: the
    law is ``bytes``).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    order = ["_k", "size", "text_crc32", "_tie"]
    narrow = docs.select(
        F.col(key).alias("_k"),
        (F.octet_length(raw) + FRAME_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_part", F.spark_partition_id()), "shard-order")

    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    everything = Window.partitionBy()
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_byte_base"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row_base"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        placed.withColumn("_run", F.sum("size").over(inside))
        .withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
        .join(F.broadcast(bases), "_part")  # bounded: one row for each shuffle partition
    )
    # In halves of a byte: the midpoint is base + run - size / 2.
    dealt = offsets.select(
        "_k",
        "size",
        "text_crc32",
        F.least(F.lit(n_shards - 1), F.expr(f"((2 * (_byte_base + _run) - size) * {n_shards}L) div (2 * _total)")).cast("int").alias("shard"),
        (F.col("_row_base") + F.col("_row") - 1).alias("_at"),
    )
    dealt = materialise(dealt, "shard-offsets")
    firsts = dealt.groupBy("shard").agg(F.min("_at").alias("_first"))
    return dealt.join(F.broadcast(firsts), "shard").select(  # bounded: n_shards rows
        F.col("_k").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The checksum is folded byte by byte over a table that is made by the polynomial's rule.
ORACLE = """
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM range(256) r(n)
), bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b
  FROM documents
), sized AS (
  SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM bytes, tab
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized
), dealt AS (
  SELECT *, least(23, CAST((2 * upto - size) * 24 AS BIGINT) // CAST(2 * total AS BIGINT)) AS shard FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""

"""Hashes that earlier runs have kept, as a stored table that a new run meets without reading or moving all of it.

The table is Parquet bucketed and sorted by hash, so a join with it exchanges the new hashes only. Beside it lies a Bloom filter:
bitmaps of 32,768 bits, a row each, made and tested with SQL's bitmap functions. A run tests its hashes there first; those that
the filter lets through are few if few are old, and only they meet the table, or nothing does.

A run's hashes are one folder of each, under the run's name: a run that was cut off leaves no success mark and is written anew
under the same name, and a run that comes twice counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.files import exists

#: Buckets of the table, bits of the filter for each hash that it is made for, and places that a hash has in it.
BUCKETS, BITS, PROBES = 64, 12, 6
#: Hashes whose passing the filter makes a look into the table by way of pushed-down values worth it.
FEW = 1000


@dataclass
class Seen:
    """Hashes under ``path``; ``expected`` is what the filter is sized for (more make it let more through, never less)."""

    spark: SparkSession
    path: str
    expected: int = 1_000_000
    buckets: int = BUCKETS

    @property
    def bits(self) -> int:
        return max(1 << 15, BITS * self.expected)

    def _runs(self, kind: str) -> list[str]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run=*/filter/_SUCCESS")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target) or []
        return [f"{f.getPath().getParent().getParent().toString()}/{kind}" for f in found]

    def _places(self, rows: DataFrame) -> DataFrame:
        """Each hash with its places in the filter: _known, _bitmap (a bitmap's number), _bit (a place in it)."""
        place = lambda k: F.pmod(F.xxhash64("_known", k), F.lit(self.bits))
        spread = F.explode(F.transform(F.sequence(F.lit(1), F.lit(PROBES)), place)).alias("_at")
        return rows.select("_known", spread).select("_known", F.bitmap_bucket_number("_at").alias("_bitmap"), F.bitmap_bit_position("_at").alias("_bit"))

    def add(self, hashes: DataFrame, run: str, name: str = "hash") -> None:
        """Keep the distinct hashes of a run; nulls are not kept. A run of that name that is there already is left alone."""
        folder = f"{self.path}/run={run}"
        if exists(self.spark, f"{folder}/filter/_SUCCESS"):
            return
        new = hashes.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("_known")).distinct()
        table = "_heddle_seen_" + str(abs(hash((self.path, run))))
        self.spark.sql(f"drop table if exists {table}")
        dealt = new.repartition(self.buckets, "_known")  # one file a bucket
        dealt.write.mode("overwrite").option("path", f"{folder}/hashes").bucketBy(self.buckets, "_known").sortBy("_known").saveAsTable(table)
        self.spark.sql(f"drop table {table}")  # the files stay: the table is external
        kept = self.spark.read.schema("_known string").parquet(f"{folder}/hashes")
        bitmaps = self._places(kept).groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        bitmaps.write.mode("overwrite").parquet(f"{folder}/filter")

    def _table(self, folder: str) -> DataFrame:
        """A run's hashes as the bucketed table that they were written as."""
        name = "_heddle_seen_" + str(abs(hash(folder)))
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"create table {name} (_known string) using parquet clustered by (_known) sorted by (_known) into {self.buckets} buckets location '{folder}'"
            )
        return self.spark.table(name)

    def passing(self, rows: DataFrame) -> DataFrame:
        """The distinct ``_known`` of ``rows`` that the filter lets through: all that were seen, and a small share of the others."""
        folders = self._runs("filter")
        merged = self.spark.read.schema("_bitmap long, _bits binary").parquet(*folders).groupBy("_bitmap").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        on = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
        tested = self._places(rows.select("_known").distinct()).join(merged, "_bitmap", "left")
        hits = tested.groupBy("_known").agg(F.count_if(F.coalesce(on, F.lit(False))).alias("_n"))
        return hits.where(F.col("_n") == PROBES).select("_known")

    def flagged(self, df: DataFrame, hash: Column | str = "hash", name: str = "_seen") -> DataFrame:
        """``df`` with whether an earlier run has kept its hash; null hashes are not seen.

        Distinct hashes are tested and joined; a mass of copies of one hash is met again by a join with the seen ones alone.
        """
        known = df.withColumn("_known", F.col(hash) if isinstance(hash, str) else hash)
        if not self._runs("filter"):
            return known.withColumn(name, F.lit(False)).drop("_known")
        candidates = self.passing(known.where(F.col("_known").isNotNull()))
        few = [r["_known"] for r in candidates.limit(FEW + 1).collect()]
        if not few:
            return known.withColumn(name, F.lit(False)).drop("_known")
        stored = None
        for folder in self._runs("hashes"):
            rows = self._table(folder)
            rows = rows.where(F.col("_known").isin(few)) if len(few) <= FEW else rows  # prunes buckets and row groups
            part = rows.join(candidates, "_known", "left_semi")
            stored = part if stored is None else stored.unionByName(part)
        old = stored.distinct().withColumn(name, F.lit(True))
        return known.join(old, "_known", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_known")

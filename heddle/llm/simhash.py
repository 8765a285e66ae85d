"""SimHash fingerprints and near-duplicate groups found by pigeonring chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.graph import Forest, connected_components, runs
from heddle.sources.shared import materialise

#: Words in a shingle, seed of its hash, differing bits that link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Widths of the segments on the ring, from the lowest bit.
SEGMENTS = (13, 13, 13, 13, 12)
#: Fingerprints of one bucket that are compared in one go; larger buckets are split into pairs of blocks.
BLOCK = 8192
#: Shares in which a group's fingerprints meet its smallest key.
SHARES = 32

_OFFSETS = np.concatenate([[0], np.cumsum(SEGMENTS)])[:-1]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the 64-bit hashes of all word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        block = hashes[low : low + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py(), shingle, seed) for t in batch.column("_text")]
        out = pa.array(np.array(values, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("_k"), out], ["_k", "_fp"])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(_k, _fp): the key and the fingerprint as a signed 64-bit number."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    return narrow.mapInArrow(lambda it: _fingerprints(it, shingle, seed), f"_k {kind}, _fp long")


def _bucket_keys(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each chain start i and each bit of the next segment: segment i, and the next one with that bit cleared.

    With 4 differing bits over 5 segments in a ring, some start has no difference in its own segment and at
    most one in that and the next together (the proportional budget 2 * 4 / 5). Two fingerprints with such a
    chain agree on at least one of these keys.
    """
    count = len(SEGMENTS)
    for i in range(count):
        j = (i + 1) % count
        own = (fps >> np.uint64(_OFFSETS[i])) & np.uint64((1 << SEGMENTS[i]) - 1)
        after = (fps >> np.uint64(_OFFSETS[j])) & np.uint64((1 << SEGMENTS[j]) - 1)
        for bit in range(SEGMENTS[j]):
            cleared = after & ~np.uint64(1 << bit)
            label = np.uint64(i * 16 + bit)
            yield i, (label << np.uint64(32)) | (own << np.uint64(16)) | cleared


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("_fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for _, keys in _bucket_keys(fps):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("_fp")], ["_key", "_fp"])


def chains(parts: np.ndarray, radius: int) -> np.ndarray:
    """Whether, by the differences in each segment of a ring (a row each), some chain of consecutive segments stays within its
    share of ``radius`` at every length. At full length the share is the radius itself."""
    count = len(parts)
    fits = np.zeros(parts.shape[1:], bool)
    for start in range(count):
        total, holds = np.zeros(parts.shape[1:], np.int16), np.ones(parts.shape[1:], bool)
        for length in range(1, count + 1):
            total = total + parts[(start + length - 1) % count]
            holds &= total * count <= length * radius
        fits |= holds
    return fits


def chain_fits(differences: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """:func:`chains` of 64-bit differences over the segments of the bucket keys."""
    cut = [(differences >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in zip(_OFFSETS, SEGMENTS, strict=True)]
    return chains(np.bitwise_count(np.stack(cut)).astype(np.int16), radius)


def _near(one: np.uint64, others: np.ndarray, radius: int) -> np.ndarray:
    """Positions of ``others`` that link with ``one``: the chains prune, the full distance decides."""
    differences = others ^ one
    passed = np.flatnonzero(chain_fits(differences, radius))
    return passed[np.bitwise_count(differences[passed]) <= radius]


def link_stars(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, root) for each linked fingerprint of a bucket but the roots: a breadth-first search.

    Whatever a search has reached is never compared again, so a dense bucket costs little more than its size.
    """
    left, out = np.sort(fps), []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            found = _near(queue.pop(), left, radius)
            if len(found):
                reached = left[found]
                out += [(int(x), int(root)) for x in reached]
                queue += list(reached)
                left = np.delete(left, found)
    return out


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for keys, parts, fps in runs(batches, ["_key", "_part", "_fp"]):
        fps = fps.astype(np.int64).view(np.uint64)
        edge = np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1
        bounds = np.concatenate([[0], edge, [len(keys)]])
        size = np.diff(bounds)
        pairs = bounds[:-1][size == 2]
        differ = fps[pairs] ^ fps[pairs + 1]
        for k in pairs[chain_fits(differ, radius) & (np.bitwise_count(differ) <= radius)]:
            forest.add(int(fps[k]), int(fps[k + 1]))
        for k in np.flatnonzero(size > 2):
            for a, b in link_stars(np.unique(fps[bounds[k] : bounds[k + 1]]), radius):
                forest.add(a, b)
    links = np.array(forest.links(), np.uint64).reshape(-1, 2).view(np.int64)
    for low in range(0, len(links), 1 << 16):
        part = links[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["a", "b"])


def link_fingerprints(distinct: DataFrame, *, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (_fp) within ``radius`` bits into their groups.

    Each fingerprint goes to 64 buckets, keyed on 25 bits (26 less the cleared one). Buckets of more
    than ``block`` fingerprints are split by a hash into blocks; each pair of blocks is searched on its
    own, so no task holds more than two blocks of a bucket and no pair is missed. Links inside a task are
    reduced to a forest before they are returned.
    """
    if radius != RADIUS:
        raise ValueError("the bucket keys are those for 4 bits over 5 segments")
    spread = distinct.select("_fp").mapInArrow(_explode_keys, "_key long, _fp long")
    spread = materialise(spread, "simhash-keys")
    sizes = spread.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    hot = materialise(sizes, "simhash-hot")
    keyed = spread.withColumn("_part", F.lit(0).cast("long"))
    if not hot.isEmpty():
        width = F.ceil(F.col("_n") / block)
        dealt = spread.join(hot, "_key", "left")
        own = F.pmod(F.xxhash64("_fp"), width)
        # Block x of n meets every block: the pairs (x, y) in which it lies, named by the smaller and the larger.
        pair = F.transform(
            F.sequence(F.lit(0).cast("long"), width - 1),
            lambda y: F.least(own, y) * width + F.greatest(own, y),
        )
        keyed = dealt.select("_key", "_fp", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("_part"))
    grouped = keyed.repartition("_key", "_part").sortWithinPartitions("_key", "_part")
    return grouped.select("_key", "_part", "_fp").mapInArrow(lambda it: _link(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint and its group's smallest key.

    Texts link when their fingerprints differ in 4 bits or fewer; a group is everything reachable. Equal
    fingerprints are one vertex, so copies cost nothing beyond their own row. Null and empty texts have
    fingerprint zero and link like any other; null keys never name a group unless it has no other key.
    Repeated rows each get a result; an empty table gives an empty result; other columns are not read.

    Returns: key, fingerprint (16 hex digits), component_id.
    """
    prints = materialise(fingerprints(docs, key=key, text=text), "simhash-prints")
    distinct = materialise(prints.groupBy("_fp").agg(F.min("_k").alias("_low")), "simhash-distinct")
    groups = connected_components(link_fingerprints(distinct))
    linked = groups.join(distinct, groups["node"] == F.col("_fp")).select("_fp", F.col("root").alias("_root"), "_low")
    linked = materialise(linked, "simhash-linked")
    # A group may hold most fingerprints, so its smallest key meets them in SHARES tasks.
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share")
    lowest = linked.groupBy("_root").agg(F.min("_low").alias("component_id")).select("*", shares)
    share = F.pmod(F.xxhash64("_fp"), F.lit(SHARES)).cast("int").alias("_share")
    met = linked.select("_fp", "_root", share).join(lowest, ["_root", "_share"]).select("_fp", "component_id")
    named = distinct.join(met, "_fp", "left").select("_fp", F.coalesce("component_id", "_low").alias("component_id"))
    return prints.join(named, "_fp").select(
        F.col("_k").alias(key),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )

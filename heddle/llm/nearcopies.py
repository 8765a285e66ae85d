"""Near copies by SimHash: fingerprints of word shingles, pigeonring chains, and an exact check of the shingle sets.

Texts are near copies when their sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more. Such sets
agree in all but about 15 % of a fingerprint's bits. Segments of a fingerprint are no bucket keys at that distance (a chain
that admits 10 of 64 bits leaves too few bits to tell buckets apart), so buckets come from the least shingle hashes of
bands; inside a bucket the chains of the 256-bit fingerprints decide which pairs are looked at:

1.  In each bucket the set whose fingerprint lies nearest to the bucket's majority bits leads; sets within TIGHT bits of
    it are linked to it, the rest go on by themselves. Each of these links is then checked on the two shingle sets.
2.  Buckets whose sets are all in one group by now are done. In the others, sets of different groups that pass the chain
    test for RADIUS bits are brought together and checked on their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.columns import quoted
from heddle.llm.graph import Forest, connected_components, runs
from heddle.sources.shared import materialise, passing
from heddle.llm.simhash import chains

#: Words in a shingle, seed of its hash, and the least similarity that links, as a fraction.
SHINGLE, SEED, SIMILARITY = 5, 42, (4, 5)
#: 64-bit words of a fingerprint (the segments of its ring), and differing bits up to which two sets are compared. A pair
#: at 0.8 differs in 38.8 bits of 256 on average, with a deviation of 5.7: it lies beyond 64 with a chance of 6e-6.
WORDS, RADIUS = 4, 64
#: Differing bits up to which a set follows the leader of its bucket.
TIGHT = 40
#: Least hashes in a band, and bands: a pair at 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
#: Sets of one bucket that are searched in one go; larger buckets are split.
BLOCK = 4096
#: Bytes of shingle hashes that are compared in one go, or twice as many; buckets of more are split again.
BLOCK_BYTES = 64 << 20
#: Bits of the filter that wanted rows are found with.
FILTER_BITS = 1 << 26

_random = np.random.default_rng(SEED)
_FLIPS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = _random.integers(0, 1 << 64, max(ROWS, WORDS), np.uint64) | np.uint64(1)
_WIDE = [f"_w{k}" for k in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, a text without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and white space
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the least values of ROWS hash functions over the set."""
    if not len(hashes):
        return np.array([], np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 1024):
        mixed = (hashes[low : low + 1024, None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k, values in enumerate(least.reshape(BANDS, ROWS).T):
        keys = (keys ^ values) * _MIX[k]
        keys ^= keys >> np.uint64(29)
    return keys


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set: the majority of each bit of WORDS mixes of the hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for low in range(0, len(hashes), 4096):
        mixed = (hashes[low : low + 4096, None] ^ _FLIPS[:WORDS]) * _MIX[:WORDS]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _FACTORS[:WORDS]
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def near(one: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Which of ``others`` pass the chain test with ``one``; a chain of all segments is the full Hamming check."""
    return chains(np.bitwise_count(others ^ one).T.astype(np.int16), radius)


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of ``others`` has at least SIMILARITY of its union with ``one`` in common."""
    over, under = SIMILARITY
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    fitting = np.flatnonzero(np.minimum(sizes, len(one)) * under >= np.maximum(sizes, len(one)) * over)
    out = np.zeros(len(others), bool)
    if len(fitting):
        flat = np.concatenate([others[k] for k in fitting])
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[fitting]) - sizes[fitting])
        out[fitting] = common * (over + under) >= over * (sizes[fitting] + len(one))
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, wide, keys, sizes = [], [], [], []
        for t in batch.column("_text"):
            found = shingles(t.as_py())
            names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            wide.append(wide_print(found).view(np.int64))
            keys.append(band_keys(found).view(np.int64))
            sizes.append(found.nbytes)
        columns = [pa.array(np.array(names, np.uint64).view(np.int64)), *(pa.array(c) for c in np.array(wide).reshape(-1, WORDS).T.copy())]
        made = [*columns, pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("_tag"), batch.column("_k"), *made], ["_tag", "_k", "_set", *_WIDE, "_keys", "_bytes"])


def _buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The column arrays of one bucket at a time; the input is sorted by its first two columns."""
    for held in runs(batches, columns, 2):
        edge = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
        bounds = np.concatenate([[0], edge, [len(held[0])]])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                yield [c[a:b] for c in held]


def _pairs(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    flat = np.array(links, np.int64).reshape(-1, 2)
    for low in range(0, len(flat), 1 << 16):
        part = flat[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["a", "b"])


def follow(names: np.ndarray, wide: np.ndarray) -> list[tuple[int, int]]:
    """(name, leader) of the sets of a bucket that lie within TIGHT bits of a leader; leaders come in order of their
    distance from the bucket's majority bits, so that other buckets with these sets choose the same."""
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    centre = np.packbits(bits * 2 > len(wide), bitorder="little").view(np.uint64)
    left = np.lexsort((names, np.bitwise_count(wide ^ centre).sum(1, dtype=np.int64)))
    out = []
    while len(left) > 1:
        lead, left = left[0], left[1:]
        reached = near(wide[lead], wide[left], TIGHT)
        out += [(int(names[x]), int(names[lead])) for x in left[reached]]
        left = left[~reached]
    return out


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links: set[tuple[int, int]] = set()
    for _, _, names, *wide in _buckets(batches, ["_key", "_part", "_set", *_WIDE]):
        links.update(follow(names.astype(np.int64), np.stack(wide, 1).astype(np.int64).view(np.uint64)))
        if len(links) > 1 << 17:
            yield from _pairs(list(links))
            links.clear()
    yield from _pairs(list(links))


def apart(groups: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which sets of a bucket pass the chain test with a set of another group."""
    kinds, of, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    out = np.zeros(len(groups), bool)
    if len(kinds) > 1:
        for x in np.flatnonzero(of != sizes.argmax()):  # a pair of different groups has one outside the largest
            reached = near(wide[x], wide, RADIUS) & (of != of[x])
            out[x] |= reached.any()
            out |= reached
    return out


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, parts, names, groups, *wide in _buckets(batches, ["_key", "_part", "_set", "_group", *_WIDE]):
        at = apart(groups, np.stack(wide, 1).astype(np.int64).view(np.uint64))
        if at.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[at].astype(np.int64)) for c in (keys, parts, names, groups)], ["_key", "_part", "_set", "_group"])


def join_groups(groups: np.ndarray, sets: list[np.ndarray], forest: Forest) -> None:
    """Join the groups of a bucket that have similar sets; what is joined already is not compared again."""
    kinds, of, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    for x in np.flatnonzero(of != sizes.argmax()):
        roots = np.array([forest.root(int(g)) for g in kinds])
        others = np.flatnonzero(roots[of] != roots[of[x]])
        for y in others[similar(sets[x], [sets[k] for k in others])] if len(others) else []:
            forest.add(int(groups[x]), int(groups[y]))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for _, _, groups, texts in _buckets(batches, ["_key", "_part", "_group", "_text"]):
        join_groups(groups.astype(np.int64), [shingles(t) for t in texts], forest)
    yield from _pairs(forest.links())


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links whose two sets are similar; the links of one leader mostly follow each other."""
    last, led = None, np.array([], np.uint64)
    for batch in batches:
        good = []
        for b, x, y in zip(batch.column("b").to_pylist(), batch.column("_x"), batch.column("_y"), strict=True):
            if b != last:
                last, led = b, shingles(y.as_py())
            good.append(bool(similar(shingles(x.as_py()), [led])[0]))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in "ab"], ["a", "b"])


def _shared(bands: DataFrame, same: str | None = None) -> DataFrame:
    """(_key, _n): buckets in which sets meet (with ``same``: that differ in it). Of buckets with the same sets one is enough."""
    meet = F.min(same) < F.max(same) if same else F.count("*") > 1
    sizes = bands.groupBy("_key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_set")).alias("_same"), meet.alias("_meet"))
    return sizes.where("_meet").groupBy("_n", "_same").agg(F.min("_key").alias("_key")).select("_key", "_n")


def _possible(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose tag is not wanted, before they cross the network.

    A bitmap of FILTER_BITS hashed tags, 8 MB in all, is broadcast; it lets every wanted row through, and of the others the share
    of its bits that are set. With many more wanted rows than bits it lets all through, and only the saving is lost.
    """
    place = F.pmod(F.xxhash64("_tag"), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bitmap")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    return _marked(rows, place, bits)


def _tagged(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose tag is wanted: one bit a tag is broadcast, so the rows, with their texts, stay where they are."""
    placed = wanted.select(F.bitmap_bucket_number("_tag").alias("_bitmap"), F.bitmap_bit_position("_tag").alias("_at")).repartition("_bitmap")
    return _marked(rows, F.col("_tag"), placed.groupBy("_bitmap").agg(F.bitmap_construct_agg("_at").alias("_bits")))


def _marked(rows: DataFrame, place: Column, bits: DataFrame) -> DataFrame:
    """``rows`` whose place is set in the bitmaps (_bitmap, _bits)."""
    placed = rows.withColumn("_at", place).withColumns({"_bitmap": F.bitmap_bucket_number("_at"), "_bit": F.bitmap_bit_position("_at")})
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return placed.join(F.broadcast(bits), "_bitmap").where(on).select(*rows.columns)


def _once(flagged: DataFrame) -> DataFrame:
    """Rows (_key, _part, _set, _group) of one bucket of those that hold the same sets: pairs mostly meet in several bands."""
    sizes = flagged.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_set")).alias("_same"))
    one = sizes.groupBy("_n", "_same").agg(F.min(F.struct("_key", "_part")).alias("_b")).select("_b._key", "_b._part")
    return flagged.join(one, ["_key", "_part"], "left_semi")


def links(docs: DataFrame, sketches: DataFrame, *, text: str, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, root) of the shingle sets (_set) of ``sketches`` (one row each) that are linked to others."""
    bands = sketches.select("_set", F.explode("_keys").alias("_key"))
    wide = sketches.select("_set", *_WIDE)
    buckets = materialise(_shared(bands), "near-buckets")
    own = F.pmod(F.xxhash64("_set"), F.ceil(F.col("_n") / block)).alias("_part")
    members = materialise(bands.join(buckets, "_key").select("_key", "_n", own, "_set"), "near-members")
    dealt = members.join(wide, "_set").repartition("_key", "_part").sortWithinPartitions("_key", "_part")
    led = materialise(dealt.select("_key", "_part", "_set", *_WIDE).mapInArrow(_follow, "a long, b long").distinct(), "near-led")

    # A set travels as its text, of which its hashes, 8 bytes a word that do not compress, are made again where they are compared.
    def texts_of(names: DataFrame, label: str) -> DataFrame:
        wanted = materialise(names.distinct().join(sketches.select("_set", "_tag", "_bytes"), "_set").select("_set", "_tag", "_bytes"), label + "-wanted")
        possible = _possible(docs.select("_tag", quoted(text).alias("_text")), wanted)
        narrow = possible.join(wanted.hint("shuffle_merge"), "_tag").select("_set", "_bytes", "_text")  # one plan at every size
        return materialise(narrow, label)

    met = texts_of(led.select(F.col("a").alias("_set")).union(led.select("b")), "near-sets")
    x, y = (met.select(F.col("_set").alias(c), F.col("_text").alias(h)) for c, h in (("a", "_x"), ("b", "_y")))
    sure = led.join(x, "a").join(y, "b").select("a", "b", "_x", "_y").mapInArrow(_checked, "a long, b long")
    groups = connected_components(sure)

    named = members.select("_key", "_set").join(groups, groups["node"] == F.col("_set"), "left").select("_key", "_set", F.coalesce("root", "_set").alias("_group"))
    named = materialise(named, "near-named")
    open_buckets = materialise(_shared(named, "_group"), "near-open")
    width = F.ceil(F.col("_n") / block)
    one = F.pmod(F.xxhash64("_set"), width)
    # Block x of n meets every block: the pairs (x, y) in which it lies, named by the smaller and the larger.
    pair = F.transform(F.sequence(F.lit(0).cast("long"), width - 1), lambda b: F.least(one, b) * width + F.greatest(one, b))
    again = named.join(open_buckets, "_key").select("_key", F.explode(pair).alias("_part"), "_set", "_group").join(wide, "_set")
    again = again.repartition("_key", "_part").sortWithinPartitions("_key", "_part").select("_key", "_part", "_set", "_group", *_WIDE)
    flagged = materialise(again.mapInArrow(_apart, "_key long, _part long, _set long, _group long"), "near-apart")
    flagged = materialise(_once(flagged), "near-once")
    asked = texts_of(flagged.select("_set"), "near-asked")
    # Long texts have large sets: a bucket of many bytes is dealt into shares, and every two shares meet, as blocks do above.
    sizes = asked.select("_set", "_bytes")
    shares = F.ceil(F.sum("_bytes") / block_bytes).alias("_m")
    loads = flagged.join(sizes, "_set").groupBy("_key", "_part").agg(shares)
    share = F.pmod(F.xxhash64("_set", F.lit(1)), F.col("_m"))
    two = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1), lambda b: F.least(share, b) * F.col("_m") + F.greatest(share, b))
    split = flagged.join(loads, ["_key", "_part"]).select("_key", "_part", "_set", "_group", F.explode(two).alias("_two"))
    named_part = (F.col("_part") * (1 << 24) + F.col("_two")).alias("_part")
    last = split.select("_key", named_part, "_set", "_group").join(asked.select("_set", "_text"), "_set").repartition("_key", "_part").sortWithinPartitions("_key", "_part")
    joined = connected_components(last.select("_key", "_part", "_group", "_text").mapInArrow(_join, "a long, b long"))
    labels = sketches.select(F.col("_set").alias("node")).join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("_group"))
    final = labels.join(joined.select(F.col("node").alias("_group"), F.col("root").alias("_root")), "_group", "left")
    return final.select("node", F.coalesce("_root", "_group").alias("root"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with exactly one row of each group of near copies: the one with the smallest key.

    Texts link when their sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more; a group is
    everything reachable. Links are checked on the sets of 64-bit shingle hashes, so none is wrong; a pair is missed only if
    it shares no band or its fingerprints differ in over RADIUS bits. Null and empty texts are one group. Null keys come
    last, and rows that tie on the key are told apart by their position, so repeated rows leave one row as well. An empty
    table gives an empty result; other columns stay as they are.
    """
    tagged = materialise(docs.withColumn("_tag", F.monotonically_increasing_id()), "near-rows")
    with passing():
        kind = docs.schema[key].dataType
        narrow = tagged.select("_tag", quoted(key).alias("_k"), quoted(text).alias("_text"))
        longs = [T.StructField(c, T.LongType()) for c in ("_set", *_WIDE)]
        schema = T.StructType([T.StructField("_tag", T.LongType()), T.StructField("_k", kind), *longs, T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_bytes", T.LongType())])
        prints = materialise(narrow.mapInArrow(_sketches, schema), "near-prints")
        # Rows of one set, a mass of copies as well, are only ever summed up partially.
        order = F.struct(F.col("_k").isNull().alias("_null"), "_k", "_tag")
        firsts = materialise(prints.groupBy("_set").agg(F.min(order).alias("_at")), "near-firsts")
        sketches = materialise(prints.join(firsts.select(F.col("_at._tag").alias("_tag")), "_tag", "left_semi").drop("_k"), "near-sketches")
        rooted = firsts.join(links(tagged, sketches, text=text, block=block, block_bytes=block_bytes), F.col("_set") == F.col("node"))
        kept = rooted.groupBy("root").agg(F.min("_at")["_tag"].alias("_tag")).select("_tag")
        kept = materialise(kept, "near-kept", lasting=True)
    return _tagged(tagged, kept).select(*[quoted(c) for c in docs.columns])

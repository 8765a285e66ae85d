"""Exact removal of repeated byte strings: sparse suffixes sorted by bucket-pointer refinement.

A bucket identifier names a string: all suffixes with the same first bytes lie in one bucket. Identifiers of
8-byte grams are refined by the identifiers at later offsets, and each result is reused by the next round:

    8 -> 16 -> 32 -> 64 -> 128 -> 200 bytes    (the last from 128 bytes here and 128 bytes 72 further on)

Identifiers are 64-bit mixes of the pair that they refine, so every task gives a string the same name without
asking the others, and sorting on (bucket, refined bucket) across the cluster is the sort of the suffixes by
these prefixes. Only what is still in a bucket with others is refined further:

1.  Every window of WIDTH bytes has an anchor, the least 64-byte bucket inside it (the leftmost of equals). Equal
    windows have the same anchor at the same place, so only anchors, one in about 70 bytes, are sorted.
2.  Consecutive windows with one anchor are a run. Runs sort by the anchor's bucket and then by the identifiers of
    the 200 bytes at the run's both ends. Runs in one bucket consist of repeated windows.
3.  Where runs share the anchor's bucket but not the run's, they are cut into blocks of 8 windows, aligned at the
    anchor. A block sorts by its core, the 193 bytes that all its windows share, and then by the up to 7 bytes on
    either side. A core that occurs once settles its block; equal blocks consist of repeated windows.
4.  Where blocks share a core only, their windows sort by core and side bytes, one by one.

Strings count as equal when the 64-bit names of bucket and refined bucket both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.columns import renamed
from heddle.sources.shared import materialise

#: Bytes of a repeated string, and of an anchor's bucket.
WIDTH, GRAM = 200, 64
#: Window starts that are named in one go, and text bytes that a task sorts before it sends anything on.
PIECE, FLUSH = 1 << 20, 12 << 20
#: Windows in a block and bytes that all of them share.
BLOCK = 8
CORE = WIDTH - BLOCK + 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SPAN = WIDTH - GRAM + 1  # places of an anchor in a window

# What a row of the exchanges says: a run that occurs once here, a run that occurs more often, windows known to repeat,
# a run whose windows are wanted.
ONE, MANY, KNOWN, WANTED = 0, 1, 2, 3


def refine(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets that ``bucket`` splits into by the bucket at a later offset."""
    out = bucket * _ODD
    out ^= out >> np.uint64(32)
    out += later
    out *= _ODD2
    out ^= out >> np.uint64(29)
    return out


def grams64(flat: np.ndarray) -> np.ndarray:
    """64-byte bucket of every position that has one."""
    n = len(flat) - 7
    words = np.empty(n, np.uint64)
    raw = flat.tobytes()
    for k in range(min(8, n)):
        words[k::8] = np.frombuffer(raw, "<u8", (n - k + 7) // 8, k)
    bucket = refine(words, words >> np.uint64(7))
    for size in (8, 16, 32):
        bucket = refine(bucket[:-size], bucket[size:])
    return bucket


def window_names(bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """200-byte buckets at some positions, refined from the 64-byte ones."""
    later = at + (WIDTH - 128)
    return refine(refine(bucket[at], bucket[at + 64]), refine(bucket[later], bucket[later + 64]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: prefix and suffix minima of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor bucket, run bucket, first window, last window) of the runs of texts laid end to end."""
    bucket = grams64(flat)
    low = np.uint64((1 << 21) - 1)
    places = np.arange(len(bucket), dtype=np.uint64)
    anchors = (_least((bucket & ~low) | places, _SPAN) & low).astype(np.int64)  # by window start
    whole = np.zeros(len(anchors), bool)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        whole[a : b - WIDTH + 1] = True
    fresh = np.ones(len(anchors), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | ~whole[:-1]
    fresh[begins[begins < len(anchors)]] = True
    first = np.flatnonzero(fresh & whole)
    closing = np.concatenate([fresh[1:] | ~whole[1:], [True]])
    last = np.flatnonzero(closing & whole)
    shape = ((anchors[first] - first) << 16 | (last - first)).astype(np.uint64)
    run = refine(refine(window_names(bucket, first), window_names(bucket, last)), shape)
    return bucket[anchors[first]], run, first, last


def _pieces(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in stretches of about PIECE bytes: (bytes, begins, ends, number of the text, offset in the text).

    A long text is cut into pieces that overlap by all but one byte of a window, so each window start is in one piece.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        lengths = np.array([len(x[2]) for x in held], np.int64)
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        return flat, ends - lengths, ends, np.array([x[0] for x in held]), np.array([x[1] for x in held])

    for k, raw in enumerate(raws):
        for at in range(0, len(raw) - WIDTH + 1, PIECE):
            part = raw[at : at + PIECE + WIDTH - 1]
            if size and size + len(part) > PIECE + WIDTH:
                yield flush()
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if size:
        yield flush()


def name_of(raw: bytes) -> tuple[int, int]:
    """The two halves of a text's 128-bit name, signed."""
    digest = np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8")
    return int(digest[0]), int(digest[1])


_FIELDS = ["bucket", "refined", "d1", "d2", "low", "high", "left", "right", "kind"]
_SCHEMA = ", ".join(f"{f} long" for f in _FIELDS[:-1]) + ", kind byte"
_SLIM = "bucket long, refined long, d1 long, d2 long, low long, high long, kind byte"


def _rows(columns: list[np.ndarray], kind) -> Iterator[pa.RecordBatch]:
    """Rows of ``columns`` (bucket, refined, d1, d2, low, high and perhaps left, right) and their kind."""
    n = len(columns[4])
    signed = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False) for c in columns]
    kinds = np.broadcast_to(np.asarray(kind, np.int8), n)
    names = [*_FIELDS[: len(columns)], "kind"]
    for a in range(0, n, 1 << 16):
        b = a + (1 << 16)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[a:b]) for c in signed), pa.array(kinds[a:b])], names)


def _known(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Windows known to repeat, neighbouring ranges of one text merged; rows are spread by their text."""
    d1, d2, low, high = columns[2:6]
    if not len(low):
        return
    order = np.lexsort((low, d2, d1))
    d1, d2, low, high = d1[order], d2[order], low[order], high[order]
    opens = np.ones(len(low), bool)
    opens[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (low[1:] > high[:-1] + 1)  # ranges of a text do not nest
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(low)]]) - 1
    none = [np.zeros(len(first), np.int64)] * (len(columns) - 6)
    yield from _rows([d1[first], low[first], d1[first], d2[first], low[first], high[last], *none], KNOWN)


def _settle(columns: list[np.ndarray], weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sort on (bucket, refined bucket); what repeats here is known here, and one row stands for it elsewhere."""
    order = np.lexsort((columns[1], columns[0]))
    b, r = columns[0][order], columns[1][order]
    opens = np.ones(len(b), bool)
    opens[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(opens)
    many = np.add.reduceat(weight[order], first) > 1
    stand = order[first]
    yield from _rows([c[stand] for c in columns], np.where(many, MANY, ONE))
    known = order[np.repeat(many, np.diff(np.concatenate([first, [len(b)]])))]
    yield from _known([c[known] for c in columns])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, int]]:
    """Distinct texts with their counts, FLUSH bytes at a time."""
    held: dict[bytes, int] = {}
    size = 0
    for batch in batches:
        for text in batch.column("_text"):
            if not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            if len(raw) < WIDTH:
                continue
            held[raw] = held.get(raw, 0) + 1
            size += len(raw)
            if size >= FLUSH:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _gathered(batches):
        raws = list(held)
        weights = np.fromiter(held.values(), np.int64, len(raws))
        names = np.array([name_of(r) for r in raws], np.int64).reshape(-1, 2)
        found: list[tuple[np.ndarray, ...]] = []
        for flat, begins, ends, number, offset in _pieces(raws):
            bucket, run, first, last = runs_of(flat, begins, ends)
            part = np.searchsorted(begins, first, "right") - 1
            shift = offset[part] - begins[part]
            found.append((bucket, run, number[part], first + shift, last + shift))
        if found:
            bucket, run, of, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
            yield from _settle([bucket, run, names[of, 0], names[of, 1], low, high], weights[of])


def _compare(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted on (bucket, refined): what occurs twice is known; rows alone in a shared bucket are wanted.

    Only the row before and the row after matter, so a bucket of any size passes through in batches.
    """
    held = before = None

    def judge(rows: list[np.ndarray], before, after: bool) -> Iterator[pa.RecordBatch]:
        """All ``rows`` if nothing comes after them, else all but the last."""
        bucket, refined, kind = rows[0], rows[1], rows[-1]
        n = len(bucket) - after
        b = np.concatenate([[before[0] if before else 0], bucket])
        r = np.concatenate([[before[1] if before else 0], refined])
        same_bucket = b[1:] == b[:-1]
        same_bucket[0] &= before is not None
        same = same_bucket & (r[1:] == r[:-1])
        next_bucket, next_same = np.append(same_bucket[1:], False)[:n], np.append(same[1:], False)[:n]
        same_bucket, same = same_bucket[:n], same[:n]
        twice = np.flatnonzero(same | next_same | (kind[:n] == MANY))
        yield from _known([c[twice] for c in rows[:-1]])
        if want:
            asked = np.flatnonzero((~same & same_bucket) | (~next_same & next_bucket))
            yield from _rows([c[asked] for c in rows[:-1]], WANTED)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
        passed = rows[-1] == KNOWN
        if passed.any():
            yield from _rows([c[passed] for c in rows[:-1]], KNOWN)
            rows = [c[~passed] for c in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        yield from judge(rows, before, True)
        if len(rows[0]) > 1:
            before = (rows[0][-2], rows[1][-2])
        held = [c[-1:] for c in rows]
    if held is not None:
        yield from judge(held, before, False)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with the names of their texts and the texts, compressed for the exchange.

    Texts shorter than a window, null and empty ones too, have no ranges; numbers instead of names deal them out evenly.
    """
    press, seen = zstandard.ZstdCompressor(level=1), 0
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("_text")]
            names = np.array([name_of(r) if len(r) >= WIDTH else (seen + k, -1) for k, r in enumerate(raws)], np.int64).reshape(-1, 2)
            seen += len(raws)
            packed = pa.array([press.compress(r) for r in raws], pa.binary())
            columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), packed],
                [*(n for n in part.schema.names if n != "_text"), "d1", "d2", "_packed"],
            )


def _blocks_of_run(flat: np.ndarray, low: int, high: int, anchor: int) -> list[np.ndarray]:
    """(core, sides, low, high, left, right) of the blocks of a wanted run, given its anchor's bucket."""
    own = flat[low : high + WIDTH]
    bucket = grams64(own)
    span = high - low
    at = span + int(np.argmax(bucket[span : span + _SPAN] == np.uint64(anchor & (1 << 64) - 1)))
    block = np.arange((at - span) // BLOCK, at // BLOCK + 1)
    start = at - BLOCK * block  # of the cores: the last window of a whole block
    first, last = np.maximum(start - (BLOCK - 1), 0), np.minimum(start, span)
    before, after = start - first, BLOCK - 1 - (start - last)  # side bytes that some window of the block has
    core = refine(refine(bucket[start], bucket[start + 64]), refine(bucket[start + 128], bucket[start + 129]))
    padded = np.concatenate([np.zeros(BLOCK, np.uint8), own, np.zeros(BLOCK, np.uint8)]).astype(np.uint64)
    left, right = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
    for k in range(BLOCK - 1):
        shift = np.uint64(8 * k)
        left |= np.where(k < before, padded[start + BLOCK - 1 - k], np.uint64(0)) << shift
        right |= np.where(k < after, padded[start + BLOCK + CORE + k], np.uint64(0)) << shift
    sides = refine(refine(left, right), (before * 16 + after).astype(np.uint64))
    left |= before.astype(np.uint64) << np.uint64(56)  # so that a window's place in the block is known later
    core = refine(core, np.full(len(block), np.uint64(anchor & (1 << 64) - 1)) + block.astype(np.uint64))
    return [core, sides, first + low, last + low, left, right]


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each wanted run into blocks and name them."""
    unpack, seen = zstandard.ZstdDecompressor(), set()
    found: list[list[np.ndarray]] = []
    held = 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return _settle(columns, np.ones(len(columns[0]), np.int64))

    for batch in batches:
        for d1, d2, packed, wanted in zip(*(batch.column(c) for c in ("d1", "d2", "_packed", "_wanted")), strict=True):
            name = (d1.as_py(), d2.as_py())
            if name in seen:  # a copy: its windows are known to repeat by their runs
                continue
            seen.add(name)
            flat = np.frombuffer(unpack.decompress(packed.as_buffer().to_pybytes()), np.uint8)
            for run in wanted.as_py():
                core, sides, low, high, left, right = _blocks_of_run(flat, run["low"], run["high"], run["bucket"])
                n = len(core)
                found.append([core, sides, np.full(n, name[0]), np.full(n, name[1]), low, high, left, right])
                held += n
            if held > 1 << 18:
                yield from flush()
                found, held = [], 0
        if len(seen) > 1 << 16:
            seen.clear()
    if found:
        yield from flush()


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name the windows of each wanted block by its core and the window's own side bytes."""
    for batch in batches:
        core, _, d1, d2, low, high, left, right = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _FIELDS[:-1])
        core, left, right = core.view(np.uint64), left.view(np.uint64), right.view(np.uint64)
        before = (left >> np.uint64(56)).astype(np.int64)
        found = []
        for step in range(BLOCK):
            at = np.flatnonzero(low + step <= high)
            ahead = before[at] - step  # bytes of this window before the core
            mask = lambda n: (np.uint64(1) << (8 * n).astype(np.uint64)) - np.uint64(1)
            own = refine(left[at] & mask(ahead), right[at] & mask(BLOCK - 1 - ahead))
            place = refine(core[at], ahead.astype(np.uint64))
            found.append([place, own, d1[at], d2[at], low[at] + step, low[at] + step])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        if len(columns[0]):
            yield from _settle(columns, np.ones(len(columns[0]), np.int64))


def removed(raw_size: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows that start in ``ranges``."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        end = min(high + WIDTH, raw_size)
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((low, end))
    return spans


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def _apply(batches: Iterator[pa.RecordBatch], finish: Callable) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        raws, cuts = [], []
        for packed, ranges in zip(batch.column("_packed"), batch.column("_ranges"), strict=True):
            raw = unpack.decompress(packed.as_buffer().to_pybytes())
            raws.append(raw)
            cuts.append(removed(len(raw), [(x["low"], x["high"]) for x in ranges.as_py()]) if ranges.is_valid else [])
        yield finish(batch, raws, cuts)


def _digest(batch: pa.RecordBatch, raws: list[bytes], cuts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_k"),
            pa.array([len(r) for r in raws], pa.int64()),
            pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64()),
            pa.array([len(c) for c in cuts], pa.int64()),
            pa.array([hashlib.sha256(_kept(r, c)).hexdigest() for r, c in zip(raws, cuts, strict=True)], pa.string()),
        ],
        ["_k", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _shorten(batch: pa.RecordBatch, raws: list[bytes], cuts: list) -> pa.RecordBatch:
    """The texts without the removed bytes; characters that a cut has split are dropped."""
    texts = [_kept(r, c).decode("utf-8", "ignore") if c else r.decode("utf-8", "surrogatepass") for r, c in zip(raws, cuts, strict=True)]
    names = [n for n in batch.schema.names if n not in ("d1", "d2", "_packed", "_ranges")]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([bool(c) for c in cuts])], [*names, "_text", "_cut"]
    )


def _exchange(rows: DataFrame, want: bool) -> DataFrame:
    dealt = rows.repartition("bucket") if want else rows.repartition("bucket", "refined")
    return dealt.sortWithinPartitions("bucket", "refined").mapInArrow(lambda it: _compare(it, want), rows.schema)


def _with_ranges(docs: DataFrame, text: str) -> DataFrame:
    """Other columns of ``docs`` with d1, d2, _packed (the text) and _ranges (window starts that repeat; null: none)."""
    texts = docs.select(F.col(text).alias("_text"))
    runs = materialise(_exchange(texts.mapInArrow(_sort_runs, _SLIM), True), "repeat-runs")
    packed = docs.withColumnRenamed(text, "_text")
    others = packed.drop("_text").schema
    packed = packed.mapInArrow(_pack, others.add("d1", "long").add("d2", "long").add("_packed", "binary"))

    wanted = runs.where(F.col("kind") == WANTED).select("d1", "d2", "low", "high", "bucket").distinct()
    lists = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("low", "high", "bucket")).alias("_wanted"))  # a text's own
    once = packed.select("d1", "d2", "_packed").dropDuplicates(["d1", "d2"])  # copies are dropped before the exchange too
    blocks = once.join(lists, ["d1", "d2"]).mapInArrow(_sort_blocks, _SCHEMA)
    blocks = materialise(_exchange(blocks, True), "repeat-blocks")
    windows = _exchange(blocks.where(F.col("kind") == WANTED).mapInArrow(_sort_windows, _SLIM), False)
    known = [x.where(F.col("kind") == KNOWN).select("d1", "d2", "low", "high") for x in (runs, blocks, windows)]
    ranges = known[0].union(known[1]).union(known[2]).distinct()
    merged = ranges.groupBy("d1", "d2").agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))
    return packed.join(merged, ["d1", "d2"], "left")


def repeated_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and a digest of what is left.

    A byte goes when a 200-byte string that covers it also starts anywhere else, in this document or
    another; strings are judged on the input. Null and empty texts, and texts under 200 bytes, lose
    nothing. Repeated rows are documents of their own and repeat each other. An empty table gives an
    empty result; other columns are not read.

    Returns: key, n_bytes, n_removed, n_spans, kept_sha256.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    out = _with_ranges(narrow, "_t").mapInArrow(
        lambda it: _apply(it, _digest), f"_k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return out.withColumnRenamed("_k", key)


def remove_repeats(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; other columns stay.

    A character that a cut splits is dropped. Documents that lose all their text keep their row with an
    empty text, and null texts stay null.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no column clashes with those used here
    inner = renamed(docs, names).withColumn("_null", F.col(names[text]).isNull())
    schema = inner.drop(names[text]).schema.add("_text", "string").add("_cut", "boolean")
    out = _with_ranges(inner, names[text]).mapInArrow(lambda it: _apply(it, _shorten), schema)
    out = out.withColumn(names[text], F.when(~F.col("_null"), F.col("_text")))
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])

"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every document window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.columns import quoted
from heddle.operators.blocks import running_before
from heddle.sources.shared import materialise

#: Words in a window.
NGRAM = 10
#: UTF-8 bytes of benchmark text that one broadcast set may hold (some 15 times that in memory); more is scanned in further passes.
BLOCK_BYTES = 4 << 20

# What a scan adds to a row: a bit a word, the names of the items hit, the number of words.
_FOUND = [T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_n_words", T.LongType())]
# Words are runs of 0-9, a-z and bytes of non-ASCII characters, after A-Z are lower-cased; the rest separates.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def split_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` ids."""
    count = len(ids) - n + 1
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _BASE
        out += ids[k : k + count]
    return out


class _Windows:
    """The distinct windows of one length as arrays sorted by hash: about 60 bytes a window, and the items that have each."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        distinct, of = np.unique(rows, axis=0, return_inverse=True)
        hashes = np.array([], np.uint64) if not len(rows) else _rolling_rows(distinct)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[of.ravel()], items], 1), axis=0)
        self.hashes, self.rows = hashes[order], distinct[order]
        self.bounds, self.items = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1].astype(np.int32)

    def find(self, rolled: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The number of the window that equals each row, by way of its hash; -1: none."""
        out = np.full(len(rolled), -1)
        low, high = np.searchsorted(self.hashes, rolled), np.searchsorted(self.hashes, rolled, "right")
        step = 0
        while (open_ := np.flatnonzero((out < 0) & (low + step < high))).size:  # more than one step only where hashes collide
            equal = (self.rows[low[open_] + step] == rows[open_]).all(1)
            out[open_[equal]] = (low + step)[open_[equal]]
            step += 1
        return out


def _rolling_rows(rows: np.ndarray) -> np.ndarray:
    """:func:`_rolling` of windows that are rows."""
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out *= _BASE
        out += column.astype(np.uint64)
    return out


class GramSet:
    """The distinct windows of some benchmark items, by window length."""

    def __init__(self, items: list[tuple[str, str | None]], ngram: int = NGRAM):
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for name, text in items:
            words = split_words(text)
            if not words:
                continue
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.uint32)  # 0: a word of no item
            n = min(ngram, len(own))
            found = np.lib.stride_tricks.sliding_window_view(own, n)
            rows.setdefault(n, []).append(found)
            owners.setdefault(n, []).append(np.full(len(found), len(self.names)))
            self.names.append(name)
        self.windows = {n: _Windows(np.concatenate(rows[n]), np.concatenate(owners[n])) for n in sorted(rows)}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the names of the items hit."""
        covered = np.zeros(len(words), bool)
        found: set[int] = set()
        if not words or not self.ids:
            return covered, set()
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, windows in self.windows.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            rolled = _rolling(ids, n)[starts]
            at = np.searchsorted(windows.hashes, rolled)
            hit = windows.hashes[np.minimum(at, len(windows.hashes) - 1)] == rolled
            starts, rolled = starts[hit], rolled[hit]
            if not len(starts):
                continue
            which = windows.find(rolled, np.lib.stride_tricks.sliding_window_view(ids, n)[starts])  # word for word
            for k in starts[which >= 0].tolist():
                covered[k : k + n] = True
            for w in np.unique(which[which >= 0]).tolist():
                found.update(windows.items[windows.bounds[w] : windows.bounds[w + 1]].tolist())
        return covered, {self.names[i] for i in found}


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Add the words and the items that one block of items hits."""
    grams: GramSet = shared.value
    for batch in batches:
        hits, items, counts = [], [], []
        for text in batch.column("_text").to_pylist():
            words = split_words(text)
            covered, names = grams.scan(words)
            hits.append(np.packbits(covered).tobytes() if names else b"")
            items.append(sorted(names))
            counts.append(len(words))
        made = [pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_hits", "_items", "_n_words"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from those of several blocks: all words and all items that any of them hits."""
    for batch in batches:
        hits, items = [], []
        for parts, names in zip(batch.column("_parts").to_pylist(), batch.column("_names").to_pylist(), strict=True):
            parts = [np.frombuffer(p, np.uint8) for p in parts or [] if p]
            hits.append(np.bitwise_or.reduce(parts).tobytes() if parts else b"")
            items.append(sorted(set().union(*(names or []))))
        kept = [n for n in batch.schema.names if n not in ("_parts", "_names")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*kept, "_hits", "_items"]
        )


def _pieces(batches: Iterator[pa.RecordBatch], ngram: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items of over ``most`` bytes as pieces of at most so many, each with whole windows; a longer window is a piece alone."""
    for batch in batches:
        names, numbers, texts = [], [], []
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = split_words(text) if len(text) * 4 > most and len(text.encode("utf-8", "surrogatepass")) > most else []
            if len(words) <= ngram:
                names.append(name), numbers.append(0), texts.append(text)
                continue
            sizes = np.cumsum([0, *(len(w) + 1 for w in words)])
            low, part = 0, 0
            while low <= len(words) - ngram:
                high = max(int(np.searchsorted(sizes, sizes[low] + most, "right")) - 1, low + ngram)
                names.append(name), numbers.append(part), texts.append(b" ".join(words[low:high]).decode("utf-8", "surrogatepass"))
                low, part = high - ngram + 1, part + 1
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["name", "part", "text"])


def _in_blocks(items: DataFrame, ngram: int, block_bytes: int) -> DataFrame:
    """Pieces of the items with the block that each lies in: neighbours whose sizes, summed, fill a block."""
    cut = items.select("name", "text").mapInArrow(lambda it: _pieces(it, ngram, max(1, block_bytes // 4)), "name string, part int, text string")
    placed = running_before(cut, F.octet_length("text"), [F.col("name"), F.col("part"), F.xxhash64("text")], "before")
    return materialise(placed.select("name", "text", F.floor(F.col("before") / block_bytes).alias("block")), "decontaminate-items")


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str], item_key: str = "item_id",
                   item_text: str = "text", ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of ``docs``, named k0, k1 and so on, with _text, _hits (bit per word), _items (sorted names) and _n_words.

    The benchmark's text is measured first. Up to ``block_bytes`` it is broadcast as one set; beyond that items are packed
    into blocks by their measured sizes, an item of over a quarter of a block as pieces that share the windows' ends, so a
    block holds at most five quarters of ``block_bytes``, or one window that is longer. The documents are scanned once a
    block, in tasks of their own, so a worker holds one block's set at a time. What the blocks hit is joined by row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("string").alias("name"), F.col(item_text).alias("text")).where(
        "name is not null and text is not null"
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packed = _in_blocks(items, ngram, block_bytes) if size > block_bytes else None
    blocks = 1 if packed is None else packed.agg(F.max("block")).first()[0] + 1
    named = docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("_text"))

    def scanned(rows: DataFrame, block: int) -> DataFrame:
        part = items if packed is None else packed.where(F.col("block") == block)
        found = [(r["name"], r["text"]) for r in part.select("name", "text").collect()]  # bounded by block_bytes, see above
        shared = spark.sparkContext.broadcast(GramSet(found, ngram))
        schema = T.StructType([*rows.schema, *_FOUND])
        return rows.mapInArrow(lambda it: _scan(it, shared), schema)

    if blocks == 1:
        return scanned(named, 0)
    rows = materialise(named.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    hit = [scanned(rows.select("_row", "_text"), k).where(F.size("_items") > 0).select("_row", "_hits", "_items") for k in range(blocks)]
    lists = reduce(DataFrame.unionByName, hit).groupBy("_row").agg(F.collect_list("_hits").alias("_parts"), F.collect_list("_items").alias("_names"))
    both = materialise(rows.join(lists, "_row", "left").drop("_row"), "decontaminate-hits")  # at most a list entry a block
    schema = T.StructType([*named.schema, *_FOUND[:2]])
    merged = both.mapInArrow(_either, schema)
    # Words are counted by a scan of no items, so there is one definition of a word.
    empty = spark.sparkContext.broadcast(GramSet([], ngram))
    counted = merged.select(*named.columns, F.col("_hits").alias("_h"), F.col("_items").alias("_i"))
    schema = T.StructType([*counted.schema, *_FOUND])
    out = counted.mapInArrow(lambda it: _scan(it, empty), schema)
    return out.select(*named.columns, F.col("_h").alias("_hits"), F.col("_i").alias("_items"), "_n_words")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
        n_hit = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in hits]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k0"),
                batch.column("_n_words"),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: words, words inside benchmark windows, items hit and whether any was.

    A window is 10 consecutive words of an item, or all words of a shorter item. Null and empty texts
    have no words; items with a null key or without words have no windows; items with equal texts are
    all named. Repeated rows each get a result; empty tables give empty results or no hits; columns
    other than key and text are not read.

    Returns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = scan_documents(docs, benchmark, keep=["doc_id"], **options).drop("_text")
    return scanned.mapInArrow(
        _digest,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``_text`` by the text without the hit words and what lies between them."""
    for batch in batches:
        texts = []
        for text, hits in zip(batch.column("_text").to_pylist(), batch.column("_hits").to_pylist(), strict=True):
            texts.append(remove_spans(text, hits) if hits else text)
        at = batch.schema.get_field_index("_text")
        yield batch.set_column(at, "_text", pa.array(texts, pa.string()))


def remove_spans(text: str, hits: bytes) -> str:
    """``text`` without the runs of hit words; separators inside a run go too, those around it stay."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    covered = np.unpackbits(np.frombuffer(hits, np.uint8), count=len(starts)).astype(bool)
    run = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    kept, at = [], 0
    for first, past in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True):
        kept.append(raw[at : starts[first]])
        at = ends[past - 1]
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", remove: str = "spans", **options) -> DataFrame:
    """``docs`` without benchmark passages: ``remove`` is ``spans`` (cut the words) or ``documents``.

    A document that is nothing but benchmark words is dropped by either; other documents and columns
    stay as they are, null texts too.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    keep = [c for c in docs.columns if c != text]
    scanned = scan_documents(docs, benchmark, text=text, keep=keep, **options)
    if remove == "documents":
        left = scanned.where(F.length("_hits") == 0)
    else:
        cut = scanned.mapInArrow(_cut, scanned.schema)
        left = cut.where((F.length("_hits") == 0) | F.col("_text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    inner = {c: f"k{i}" for i, c in enumerate(keep)} | {text: "_text"}
    return left.select(*[F.col(inner[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS gram
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n
), hits AS (
  SELECT d.doc_id, d.k, d.n, i.item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.gram = i.gram
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Pieces are sorted by length, longest first, by a range exchange, so a piece's place in that order says its length and its rank
among pieces of that length. A round takes all pieces of one length. The open sequences, sorted by their gap, are swept upwards
from that length: each gap takes as many of the pieces as fit before the next larger gap is touched, ranks decide which piece
goes where, and the gaps shrink before the next round. What finds no gap opens new sequences.

Gaps are whole numbers below the capacity and sequences of one gap are interchangeable, so the sorted gaps are kept as runs
(gap, first sequence, number of sequences). Only counts pass through the driver: one a length, one a partition, and runs of gaps,
whose number depends on the capacity and not on the corpus. Rows are matched with their sequences in distributed tasks, by place.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.bpe import _OTHER, codec, slices
from heddle.llm.columns import quoted
from heddle.sources.shared import materialise

#: Bits of a row's place inside its partition, in Spark's monotonically increasing ids.
INSIDE = 33


class Ids:
    """The library's ids of whole texts.

    tiktoken merges the same vocabulary faster; a text with characters on which the two split differently, or with what may be
    an added token, goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        own = codec(path)
        self.library, self.heads = own.library, own.heads
        self.library.no_truncation()
        self.library.no_padding()
        added = set(own.specials.values())
        ranks = {t: i for i, t in own.bytes_of.items() if i not in added}
        if not (np.diff(own.made) > 0).all():
            raise ValueError("the vocabulary's ids do not follow its merges")
        # Fixed value: the pre-token pattern of this vocabulary family.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> list[int]:
        if _OTHER.search(text) or any(h in text for h in self.heads):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """One encoder a worker process and vocabulary file; the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences but for the first piece, which takes the rest."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = ids_of(path)
    for batch in slices(batches):
        at, piece, start, length, sums, parts = [], [], [], [], [], []
        for k, text in enumerate(batch.column("_text").to_pylist()):
            tokens = np.array([*encoder.of(text or ""), end_id], "<u4")
            for p, (low, n) in enumerate(cut(len(tokens), capacity)):
                at.append(k)
                piece.append(p)
                start.append(low)
                length.append(n)
                sums.append(zlib.crc32(tokens[low : low + n]))
                if with_ids:
                    parts.append(tokens[low : low + n])
        columns = [
            batch.column("_k").take(pa.array(at, pa.int32())),
            pa.array(piece, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(sums, pa.int64()),
        ]
        names = ["_k", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            flat = np.concatenate(parts).view("<i4") if parts else np.array([], "<i4")
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, *, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids and ``end_id``, in pieces of at most ``capacity``: key, piece, start, length, ids_crc32 (and ids).

    Null and empty texts are the end id alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(quoted(key).alias("_k"), quoted(text).alias("_text"))
    schema = f"_k {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    out = narrow.mapInArrow(lambda it: _pieces(it, vocabulary, capacity, end_id, with_ids), schema)
    return out.withColumnRenamed("_k", key)


class Gaps:
    """Open sequences by the room that is left in them, as runs of sequence numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, sequences)]
        self.open = np.zeros(capacity + 1, bool)  # gaps that some sequence has
        self.sequences = 0

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.runs.setdefault(gap, []).append((first, n))
            self.open[gap] = True

    def place(self, size: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """One round: ``n`` pieces of ``size`` into the smallest gaps that hold them, the rest into new sequences.

        Gives (pieces, first sequence, offset in it, pieces a sequence) for each run of sequences that takes some.
        """
        for gap in (np.flatnonzero(self.open[size:]) + size).tolist():
            each, held = gap // size, self.runs.pop(gap)
            self.open[gap] = False
            while held and n:
                first, many = held.pop()
                whole = min(many, n // each)
                if whole:
                    yield whole * each, first, self.capacity - gap, each
                    self.put(gap - each * size, first, whole)
                    n -= whole * each
                if n and whole < many:  # fewer pieces than one more sequence takes
                    yield n, first + whole, self.capacity - gap, each
                    self.put(gap - n * size, first + whole, 1)
                    n, whole = 0, whole + 1
                if whole < many:
                    held.append((first + whole, many - whole))
            for first, many in held:
                self.put(gap, first, many)
            if not n:
                return
        each = self.capacity // size
        first, whole, rest = self.sequences, n // each, n % each
        if n:
            yield n, first, 0, each
        self.put(self.capacity - each * size, first, whole)
        if rest:
            self.put(self.capacity - rest * size, first + whole, 1)
        self.sequences += whole + bool(rest)


def rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where pieces go, by place in the order of length, longest first: rows (first place, length, first sequence, offset, pieces a sequence)."""
    gaps, at, out = Gaps(capacity), 0, []
    for size in sorted(counts, reverse=True):
        for n, sequence, offset, each in gaps.place(size, counts[size]):
            out.append((at, size, sequence, offset, each))
            at += n
    return np.array(out or [(0, 1, 0, 0, 1)], np.int64)


def _matched(batches: Iterator[pa.RecordBatch], bases: dict[int, int], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row's sequence and offset, from its place in the order of all rows."""
    first, size, sequence, offset, each = runs.T
    for batch in batches:
        place = batch.column("_place").to_numpy()
        parts = place >> INSIDE
        base = np.array([bases[p] for p in np.unique(parts).tolist()], np.int64)[np.unique(parts, return_inverse=True)[1]] if len(place) else place
        at = base + (place & (1 << INSIDE) - 1)
        run = np.searchsorted(first, at, "right") - 1
        rank = at - first[run]
        added = [pa.array(sequence[run] + rank // each[run]), pa.array(offset[run] + rank % each[run] * size[run])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_sequence", "_offset"])


def best_fit(items: DataFrame, size: str = "length", capacity: int = 2048, *, sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """``items`` with the sequence that each lies in and its place there: best fit, longest first.

    Sizes are 1 to ``capacity``; another size, or none, fails the query. Places in a sequence have no gaps. Which of several items
    of one size goes where is arbitrary. Equal sizes are dealt over many tasks, whatever their number. An empty table stays empty.
    """
    right = F.when(quoted(size).between(1, capacity), quoted(size).cast("long")).otherwise(F.raise_error(F.lit(f"sizes are 1 to {capacity}")))
    inner = {c: f"c{k}" for k, c in enumerate(items.columns) if c not in (sequence, offset)}
    named = items.select(*[quoted(c).alias(n) for c, n in inner.items()], right.alias("_size"), F.monotonically_increasing_id().alias("_tie"))
    ranged = named.repartitionByRange(F.desc("_size"), "_tie").sortWithinPartitions(F.desc("_size"), "_tie").drop("_tie")
    # Written, because places and counts must come from one and the same cut into ranges.
    placed = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()), "packing-order")
    counts = {r["_size"]: r["n"] for r in placed.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    parts = placed.groupBy(F.shiftright("_place", INSIDE).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    ends = np.cumsum([0, *(r["n"] for r in parts)]).tolist()
    bases = dict(zip((r["part"] for r in parts), ends, strict=False))
    runs = rounds(counts, capacity)
    added = [T.StructField("_sequence", T.LongType()), T.StructField("_offset", T.LongType())]
    out = placed.mapInArrow(lambda it: _matched(it, bases, runs), T.StructType([*placed.schema, *added]))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], F.col("_sequence").alias(sequence), F.col("_offset").alias(offset))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, *, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document is its text's ids and ``end_id``; only longer ones are cut. Null and empty texts are the end id alone. Repeated rows
    and null keys are documents of their own; other columns are not read; an empty table gives no rows.
    """
    return best_fit(materialise(pieces(docs, vocabulary, capacity, end_id=end_id, key=key, text=text, with_ids=with_ids), "packing-pieces"), "length", capacity)

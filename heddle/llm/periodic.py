"""Periodic runs in the words of documents: every lag compared, true stretches measured.

A run with period q shows as a stretch of places where a word equals the word q places later. All lags from 1 to a quarter of a
document's words are compared, on arrays of word ids. A run's stretch is at least three periods long, so at lag q it covers three
neighbouring multiples of q: the shift is first compared at those multiples, for all documents of a batch at once, and whole for
the documents in which three in a row agree. That loses nothing and leaves n/q comparisons for a lag without runs.

Documents whose lags are more than LAGS go to tasks by ranges of lags, and their runs are brought together by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.bpe import slices
from heddle.llm.columns import quoted
from heddle.sources.shared import materialise

#: A run holds at least so many of its periods, and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Lags that one task compares of one document; a document of n words has n / LEAST_PERIODS of them.
LAGS = 1 << 20
#: Rows and text bytes that are looked at together; a longer text is looked at alone.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

# Bytes between words are 1: space, tab, line feed, vertical tab, form feed, carriage return.
_GAPS = bytes(1 if b == 32 or 9 <= b <= 13 else 0 for b in range(256))


class Words:
    """The words of a batch of texts: bytes of all texts with a space after each, word bounds, ids, and the first word of each text."""

    def __init__(self, texts: pa.Array):
        raw = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
        self.raw = b" ".join([*raw, b""])
        self.flat = np.frombuffer(self.raw, np.uint8)
        gap = np.frombuffer(self.raw.translate(_GAPS), np.uint8).astype(bool)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]  # every word is followed by a gap
        ends = np.concatenate([[0], np.cumsum(self.end - self.begin)]).astype(np.int64)
        kept = pa.py_buffer(self.flat[~gap])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(ends), kept])
        self.ids = words.dictionary_encode().indices.to_numpy().copy()
        self.first = np.searchsorted(self.begin, self.bytes_at)  # of each text, and the number of all words

    def loop(self, text: int, start: int, period: int) -> None:
        """From word ``start`` of a text on, its words become those of the first ``period`` words there, again and again."""
        low, high = int(self.first[text]) + start, int(self.first[text + 1])
        source = low + np.arange(high - low) % period
        for x in (self.ids, self.begin, self.end):
            x[low:high] = x[source]

    def kept(self, text: int, dropped: np.ndarray | None) -> bytes:
        """The words of a text that are not ``dropped``, joined by one space."""
        low, high = int(self.first[text]), int(self.first[text + 1])
        at = np.arange(low, high) if dropped is None else low + np.flatnonzero(~dropped)
        if not len(at):
            return b""
        begin, size = self.begin[at], self.end[at] - self.begin[at] + 1
        out = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        joined = self.flat[out].copy()
        joined[np.cumsum(size) - 1] = 32
        return joined[:-1].tobytes()


def stretches(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the stretches of ``ids`` with period ``lag`` that are long enough for a run."""
    same = np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2] + lag
    enough = length >= max(LEAST_WORDS, LEAST_PERIODS * lag)
    return start[enough], length[enough]


def _divisors(n: int) -> list[int]:
    """The quotients of ``n`` by its primes: a smaller period that divides ``n`` divides one of them."""
    out, rest, p = [], n, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(n // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([n // rest] if rest > 1 else [])


def runs_of(words: Words, low: np.ndarray, high: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, of periods from ``low`` to below ``high``, by start and period."""
    sizes = np.diff(words.first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    order = np.argsort(-sizes, kind="stable")
    # Texts from long to short in one array: those that have a lag are the first ones.
    ids = np.concatenate([words.ids[words.first[k] : words.first[k + 1]] for k in order.tolist()] or [np.array([], np.int32)])
    ends = np.cumsum(sizes[order])
    most = np.minimum(sizes // LEAST_PERIODS, high - 1)[order]
    with_lag = np.searchsorted(-(sizes // LEAST_PERIODS)[order], -np.arange(1, int(most.max(initial=0)) + 2), "right")
    for lag in range(max(1, int(low.min(initial=1))), int(most.max(initial=0)) + 1):
        texts = int(with_lag[lag - 1])
        if not texts:
            break
        some = ids[: ends[texts - 1] : lag]
        same = some[1:] == some[:-1]
        seen = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * lag
        if not len(seen):
            continue
        for k in np.unique(np.searchsorted(ends, seen, "right")).tolist():
            text = int(order[k])
            if not (low[text] <= lag < high[text] and lag * LEAST_PERIODS <= sizes[text]):
                continue
            own = ids[ends[k] - sizes[text] : ends[k]]
            for start, length in zip(*(x.tolist() for x in stretches(own, lag)), strict=True):
                # A smaller period of four periods of length ``lag`` divides it, and shows in the first of them.
                if not any(np.array_equal(own[start : start + lag - d], own[start + d : start + lag]) for d in _divisors(lag)):
                    out[text].append((start, length, lag))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _looped(words: Words, seeds: list[int | None]) -> None:
    for text, seed in enumerate(seeds):
        n = int(words.first[text + 1] - words.first[text])
        if seed is not None and n:
            start = seed % n
            words.loop(text, start, 1 + (n - start) // (3 + seed % 8))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Words that lie in some run after its first period."""
    if not runs:
        return None
    start, length, period = np.array(runs, np.int64).T
    depth = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in slices(batches, BATCH_ROWS, BATCH_BYTES):
        words = Words(batch.column("_text"))
        _looped(words, batch.column("_seed").to_pylist())
        yield batch, words


def _found(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows (_text, _seed, _tag, _part): part p looks at the lags p * width + 1 to (p + 1) * width."""
    for batch, words in _batches(batches):
        part = batch.column("_part").to_numpy()
        found = runs_of(words, part * width + 1, part * width + width + 1)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
        triples = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([batch.column("_tag"), pa.ListArray.from_arrays(pa.array(ends), triples)], ["_tag", "_runs"])


def _collapsed(batches: Iterator[pa.RecordBatch], every_lag: bool) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _text, _seed, _runs) to keys, runs and texts without repeats; with ``every_lag`` the runs are sought here."""
    for batch, words in _batches(batches):
        sizes = np.diff(words.first)
        if every_lag:
            found = runs_of(words, np.ones(len(sizes), np.int64), sizes + 1)
        else:
            found = [sorted(((r["start"], r["length"], r["period"]) for r in x or []), key=lambda r: (r[0], r[2])) for x in batch.column("_runs").to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
        triples = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
        texts = pa.array([words.kept(k, _dropped(int(n), x)) for k, (n, x) in enumerate(zip(sizes, found, strict=True))], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_k"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), triples), texts.cast(pa.string())],
            ["_k", "n_words", "runs", "collapsed"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        rows = []
        for runs, text in zip(batch.column("runs").to_pylist(), batch.column("collapsed"), strict=True):
            runs = [(r["start"], r["length"], r["period"]) for r in runs]
            best = strongest(runs)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            rows.append((len(runs), *most, sha(lines), sha(text.as_buffer())))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), *columns], ["_k", *DIGEST])


DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
_RUNS = "array<struct<start: long, length: long, period: long>>"


def find_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", looped: Column | None = None, lags: int = LAGS) -> DataFrame:
    """Periodic runs of whole texts: key, n_words, runs (start, length, period; by start and period), collapsed.

    Words are what lies between ASCII white space. A run is a longest stretch of words with smallest period q that holds at least
    4 * q and 6 words. ``collapsed`` is the text's words, joined by one space, without those that lie in a run after its first
    period. ``looped`` plants runs: the tail of a document becomes periodic from a word on that this number decides (null: nowhere).

    Null and empty texts have no words. Repeated rows and null keys get rows of their own; other columns are not read; an empty
    table gives none. A document's runs are at most its words, so they come together in one row.
    """
    kind = docs.schema[key].dataType.simpleString()
    seed = F.lit(None).cast("long") if looped is None else looped.cast("long")
    rows = docs.select(quoted(key).alias("_k"), quoted(text).alias("_text"), seed.alias("_seed"))
    # A word takes two bytes at least, with its gap.
    parts = F.ceil((F.coalesce(F.octet_length("_text"), F.lit(0)) + 1) / (2 * LEAST_PERIODS * lags))
    out = f"_k {kind}, n_words long, runs {_RUNS}, collapsed string"
    short = rows.where(parts <= 1).mapInArrow(lambda it: _collapsed(it, True), out)
    long = materialise(rows.where(parts > 1).withColumn("_tag", F.monotonically_increasing_id()), "periodic-long")
    dealt = long.select("_tag", "_text", "_seed", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part")).repartition("_tag", "_part")
    found = dealt.mapInArrow(lambda it: _found(it, lags), f"_tag long, _runs {_RUNS}")
    together = found.groupBy("_tag").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    whole = long.join(together, "_tag").select("_k", "_text", "_seed", "_runs").mapInArrow(lambda it: _collapsed(it, False), out)
    return short.unionByName(whole).withColumnRenamed("_k", key)


def run_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lags: int = LAGS) -> DataFrame:
    """Per document the number of runs, the one with most periods, and digests of all runs and of the collapsed text.

    A tenth of the documents, by the checksum of their key, get a periodic tail first. Null keys get none.
    """
    kind = docs.schema[key].dataType.simpleString()
    h = F.crc32(quoted(key).cast("string").cast("binary"))
    looped = F.when(h % 10 == 0, F.floor(h / 10))
    found = find_runs(docs, key=key, text=text, looped=looped, lags=lags).select(quoted(key).alias("_k"), "runs", "collapsed")
    schema = f"_k {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return found.mapInArrow(_digest, schema).withColumnRenamed("_k", key)

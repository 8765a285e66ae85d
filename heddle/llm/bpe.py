"""Byte-level BPE by forced-boundary splitting: exact encoding and decoding of whole texts."""

from __future__ import annotations

import ctypes
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.columns import renamed

#: Entries that a worker's caches of chunks, of texts' first chunks and of pre-tokens may hold, and the longest entry.
CACHE_SPACED, CACHE_OPENING, CACHE_PIECES, CACHE_CHARS = 250_000, 20_000, 150_000, 48
#: Longest fragment that is merged in the batched form; longer ones are merged one by one with a heap.
BATCHED_BYTES = 40

# Fixed value: the pre-token pattern of this vocabulary family, with its classes spelled for Latin text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Characters on which Python's classes and the library's are the same; texts with others are split by the library.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
_ODD_SPACE = re.compile("  | \n|\n |[\t\r\x0b\x0c]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def _check_splitter(spec: dict) -> None:
    """Raise unless texts are split as :data:`_PIECES` splits them, with nothing done to them before."""
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("a vocabulary without a normaliser, with the byte-level splitter, is needed")
    if any(t.get(p) for t in spec.get("added_tokens", []) for p in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings are not supported")


class Codec:
    """A byte-level BPE vocabulary as tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE vocabulary without affixes is needed")
        _check_splitter(spec)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.path = path
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.first = np.array([vocab[c] for c in letters], np.int64)

        inside = np.zeros((256, 256), bool)
        for i, token in self.bytes_of.items():
            if i not in self.specials.values() and len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                inside[b[:-1], b[1:]] = True
        self.inside = inside  # pairs that occur in some token; between all others a cut is certain

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = np.array([vocab[a + b] for a, b in merges] or [0], np.int64)
        self._index()
        marks = [re.escape(t) for t in self.specials]
        self.mark = re.compile("(" + "|".join(marks) + ")") if marks else None
        self.heads = {t[0] for t in self.specials}  # a text without any of these letters holds no added token
        self.opening: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """The library's tokenizer, for the few texts that it has to split."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Empty the caches and give their memory back; an idle worker then holds little more than its tables."""
        for cache in (self.opening, self.spaced, self.pieces):
            cache.clear()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux
            trim(0)

    def _index(self) -> None:
        """Rank of a pair of ids as a few gathers: slots hashed by the pair, what collides goes to the next table."""
        self.tables = []
        keys = np.array([(a << 32) | b for a, b in self.ranks], np.uint64)
        ranks = np.array(list(self.ranks.values()), np.int64)
        factor = np.uint64(0x9E3779B97F4A7C15)
        while len(keys):
            bits = max(8, (len(keys) * 16).bit_length())
            slot = (keys * factor) >> np.uint64(64 - bits)
            _, firsts = np.unique(slot, return_index=True)
            held, value = np.full(1 << bits, np.iinfo(np.uint64).max), np.zeros(1 << bits, np.int32)
            held[slot[firsts]], value[slot[firsts]] = keys[firsts], ranks[firsts]
            self.tables.append((factor, np.uint64(64 - bits), held, value))
            keys, ranks = np.delete(keys, firsts), np.delete(ranks, firsts)
            factor = np.uint64((int(factor) * 3 | 1) & (1 << 64) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(keys.shape, np.iinfo(np.int64).max)
        for factor, shift, held, value in self.tables:
            slot = (keys * factor) >> shift
            hit = held[slot] == keys
            out[hit] = value[slot[hit]]
        return out

    def _merge_alike(self, rows: np.ndarray) -> list[bytes]:
        """Encode fragments of one length together: each round merges every fragment's first lowest pair."""
        out: list[bytes] = [b""] * len(rows)
        ids, at = self.first[rows], np.arange(len(rows))
        none = np.iinfo(np.int64).max
        while len(at):
            if ids.shape[1] > 1:
                ranks = self._rank(ids[:, :-1], ids[:, 1:])
                best = ranks.argmin(1)
                low = ranks[np.arange(len(at)), best]
                done = low == none
            else:
                done = np.ones(len(at), bool)
            for k, row in zip(at[done].tolist(), ids[done].astype("<u4"), strict=True):
                out[k] = row.tobytes()
            if done.all():
                break
            at, ids, best, low = at[~done], ids[~done], best[~done], low[~done]
            column = np.arange(ids.shape[1] - 1)
            merged = np.where(column <= best[:, None], ids[:, :-1], ids[:, 1:])
            merged[np.arange(len(at)), best] = self.made[low]
            ids = merged
        return out

    def _merge_long(self, fragment: bytes) -> bytes:
        """Encode one long fragment: linked symbols and a heap of (rank, position)."""
        ids = self.first[np.frombuffer(fragment, np.uint8)].tolist()
        n = len(ids)
        before, after, ranks = list(range(-1, n - 1)), [*range(1, n), -1], self.ranks
        heap = [(ranks[p], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            rank, k, pair = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0 or (ids[k], ids[right]) != pair:
                continue
            ids[k], ids[right] = int(self.made[rank]), -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left, at in ((before[k], k), (k, after[k])):
                if left >= 0 and at >= 0 and (p := (ids[left], ids[at])) in ranks:
                    heapq.heappush(heap, (ranks[p], left, p))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def cut(self, piece: bytes) -> list[bytes]:
        """Fragments of ``piece`` between byte pairs that lie inside no token."""
        b = np.frombuffer(piece, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist(), len(piece)]
        return [piece[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: split at forced boundaries, encode the fragments, concatenate."""
        pieces = list(pieces)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        joined = b"".join(raw)
        if not joined:
            return dict.fromkeys(pieces, b"")
        flat = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        is_cut = np.zeros(len(flat) + 1, bool)
        is_cut[1:-1] = ~self.inside[flat[:-1], flat[1:]]
        is_cut[ends] = is_cut[0] = True
        cuts = np.flatnonzero(is_cut)
        lengths = np.diff(cuts)
        parts: list[bytes] = [b""] * len(lengths)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            if length > BATCHED_BYTES:
                for k in at.tolist():
                    parts[k] = self._merge_long(joined[cuts[k] : cuts[k + 1]])
                continue
            for low in range(0, len(at), 1 << 14):
                some = at[low : low + (1 << 14)]
                for k, ids in zip(some.tolist(), self._merge_alike(flat[cuts[some][:, None] + np.arange(length)]), strict=True):
                    parts[k] = ids
        counts = np.diff(np.searchsorted(cuts, np.concatenate([[0], ends]))).tolist()
        fragments = iter(parts)
        return {p: b"".join(islice(fragments, n)) for p, n in zip(pieces, counts, strict=True)}

    def _of_pieces(self, split: list[list[str]]) -> list[bytes]:
        known = self.pieces
        new = set().union(*split).difference(known)
        known.update(self._encode_pieces(new))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        _trim(known, new, CACHE_PIECES)
        return out

    def _split(self, part: str) -> list[str]:
        """Pre-tokens of a text between added tokens."""
        if _OTHER.search(part):
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return _PIECES.findall(part)

    def _learn(self, cache: dict[str, bytes], prefix: str, chunks: set[str]) -> set[str]:
        """Encode the chunks that ``cache`` lacks. A chunk ends where a lone space begins, so it splits on its own."""
        new = chunks.difference(cache)
        cache.update(zip(new, self._of_pieces([_PIECES.findall(prefix + c) for c in new]), strict=True))
        return new

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as the library gives them without added tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        whole: list[tuple[int, int, list[str]]] = []  # (text, place, pre-tokens)
        chunked: list[tuple[int, int, list[str]]] = []  # (text, place, chunks)
        for k, text in enumerate(texts):
            for part in self.mark.split(text) if any(h in text for h in self.heads) else (text,):
                if part in self.specials:
                    out[k].append(np.array([self.specials[part]], "<u4").tobytes())
                elif part:
                    odd = _ODD_SPACE.search(part) or _OTHER.search(part)
                    (whole if odd else chunked).append((k, len(out[k]), self._split(part) if odd else part.split(" ")))
                    out[k].append(b"")
        for (k, at, _), ids in zip(whole, self._of_pieces([x[2] for x in whole]), strict=True):
            out[k][at] = ids
        opening, spaced = self.opening, self.spaced
        first = self._learn(opening, "", {c[0] for _, _, c in chunked})
        later = self._learn(spaced, " ", set().union(*(c[1:] for _, _, c in chunked)))
        for k, at, chunks in chunked:
            out[k][at] = opening[chunks[0]] + b"".join(map(spaced.__getitem__, chunks[1:]))
        _trim(opening, first, CACHE_OPENING)
        _trim(spaced, later, CACHE_SPACED)
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _trim(cache: dict[str, bytes], new: set[str], most: int) -> None:
    """Keep a cache small: long entries go at once, all entries when there are too many."""
    if len(cache) > most:
        cache.clear()
    else:
        for entry in new:
            if len(entry) > CACHE_CHARS:
                del cache[entry]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary file."""
    return Codec(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 4 << 20, text: str = "_text") -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of rows and, but for single long texts, of text bytes."""
    for batch in batches:
        low, held = 0, 0
        sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text)]
        for k, n in enumerate(sizes):
            if k > low and (held + n > size or k - low >= rows):
                yield batch.slice(low, k - low)
                low, held = k, 0
            held += n
        if low < batch.num_rows:
            yield batch.slice(low)


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches):
        encoded = own.encode_batch([t or "" for t in batch.column("_text").to_pylist()])
        decoded = [own.decode(ids) for ids in encoded]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_k"),
                pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string()),
            ],
            ["_k", "n_tokens", "ids_sha256", "decoded_sha256"],
        )
    own.forget()


def token_digests(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode it again, and return counts and digests.

    Null and empty texts have no tokens. Strings of added tokens inside a text become those tokens, as in
    the library. Repeated rows each get a result; an empty table gives an empty result; other columns are
    not read.

    Returns: key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    out = narrow.mapInArrow(
        lambda it: _digest(it, vocabulary), f"_k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("_k", key)


def _ids(batches: Iterator[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        encoded = own.encode_batch(texts)
        offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in encoded])]).astype(np.int32)
        flat = np.frombuffer(b"".join(encoded), "<i4")
        out = batch.append_column("_ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        if check:
            same = [own.decode(ids) == t for ids, t in zip(encoded, texts, strict=True)]
            out = out.append_column("_exact", pa.array(same, pa.bool_()))
        yield out
    own.forget()


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", ids: str = "ids", exact: str | None = None) -> DataFrame:
    """``docs`` with an array column ``ids`` at the end; existing columns of that name are replaced.

    With ``exact`` the ids are decoded again in the same pass, and that column says whether they give the text.
    """
    inner = {c: "_text" if c == text else f"c{k}" for k, c in enumerate(docs.columns)}  # so that no name clashes
    named = renamed(docs, inner)
    made = [T.StructField("_ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("_exact", T.BooleanType())] if exact else [])
    out = named.mapInArrow(lambda it: _ids(it, vocabulary, exact is not None), T.StructType([*named.schema, *made]))
    added = [F.col("_ids").alias(ids)] + ([F.col("_exact").alias(exact)] if exact else [])
    return out.select(*[F.col(n).alias(c) for c, n in inner.items() if c not in (ids, exact)], *added)


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in batch.column("_ids").to_pylist()]
        yield batch.append_column("_decoded", pa.array(texts, pa.string()))


def decode(tokens: DataFrame, vocabulary: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the decoded text in column ``text`` at the end; null id lists give null."""
    inner = {c: "_ids" if c == ids else f"c{k}" for k, c in enumerate(tokens.columns)}
    named = renamed(tokens, inner)
    out = named.mapInArrow(lambda it: _texts(it, vocabulary), T.StructType([*named.schema, T.StructField("_decoded", T.StringType())]))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items() if c != text], F.col("_decoded").alias(text))

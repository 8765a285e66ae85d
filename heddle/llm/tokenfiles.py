"""Token-id files: Parquet list columns, delta encoded, with bounded row groups and page indexes."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.bpe import slices
from heddle.sources.shared import new_path

#: Words that a worker's cache may hold (about 200 bytes each), and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 240_000, 48
#: Rows and text bytes that are encoded together; a longer text is encoded alone.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

#: Writer settings. Ids are unordered and nearly uniform in width, so they are delta-binary packed instead of
#: dictionary coded; the small metadata columns come first and have pages of their own, so both can be read alone.
#: Column and offset indexes are written for every page.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#ids.list.element": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
}


# Kinds of bytes: ASCII letters and digits, ASCII marks, white space, all else; and each byte with ASCII capitals folded.
_ALNUM, _MARK, _SPACE = 1, 2, 3
_KINDS = bytes(
    _ALNUM if chr(b).isascii() and chr(b).isalnum() else _MARK if 32 < b < 127 else _SPACE if bytes([b]).isspace() else 0 for b in range(256)
)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordEncoder:
    """The library's ids by white-space word: such words encode alone as they do inside a text.

    The vocabulary's normaliser and splitter treat runs of white space as gaps without ids, so a text's ids are its
    words' ids in order. Only ASCII white space and marks are split at; all else inside a word is left to the library.
    Words are told apart by Arrow, a batch at a time, and each distinct one is looked up in a cache of two generations:
    what is still in use when the younger is full moves on, the rest goes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece of a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.folds = self._each([b"Ab"]) == self._each([b"ab"])
        if self._each([b"a b", b"a\tb\r\nb"]) != [b"".join(self._each([b"a", b"b"])), b"".join(self._each([b"a", b"b", b"b"]))]:
            raise ValueError("this vocabulary gives ids to white space")
        # The library's model behind a splitter at white space alone: words of a to z pass its own normaliser and
        # splitter unchanged, so this gives the same ids sooner. A vocabulary of which that is not so does without.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = " ".join([*map(chr, range(97, 123)), "whiteness", "zqxjkvbpyg", "".join(map(chr, range(97, 123)))])
        if self.plain.encode(probe).ids != self.library.encode(probe, add_special_tokens=False).ids:
            self.plain = self.library

    def _each(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for low in range(0, len(words), 1024):
            texts = [w.decode("utf-8", "surrogatepass") for w in words[low : low + 1024]]
            out += [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def _together(self, library, words: list[bytes], known: dict[bytes, bytes]) -> None:
        """Ids of distinct words of letters: they are one piece each, so many go through the library as one text."""
        for low in range(0, len(words), 4096):
            some = words[low : low + 4096]
            text = b" ".join(some).decode("utf-8", "surrogatepass")
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):  # each word has a last piece, so each has just one
                raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
                known.update(zip(some, (raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))

    def _alone(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words."""
        known: dict[bytes, bytes] = {}
        letters = [w for w in words if w.isalpha() and w.islower()]  # bytes: a to z only
        self._together(self.plain, letters, known)
        others = [w for w in words if w not in known]
        self._together(self.library, [w for w in others if w.decode("utf-8", "surrogatepass").isalpha()], known)
        rest = [w for w in others if w not in known]
        known.update(zip(rest, self._each(rest), strict=True))
        return known

    def _of(self, words: list[bytes], often: np.ndarray) -> list[bytes]:
        """Ids of distinct words, by way of the caches; words that are not ``often`` met are not worth a place in them."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        known = {w: old[w] for k in missing if (w := words[k]) in old}
        known |= self._alone([w for k in missing if (w := words[k]) not in known])
        for k in missing:
            word = words[k]
            ids = found[k] = known[word]
            if often[k] and len(word) <= CACHE_BYTES:
                young[word] = ids
        if len(young) > CACHE_WORDS // 2:
            self.young, self.old = {}, young
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text) of a string array; null texts have none.

        ASCII marks are cut off after a letter or digit, where the vocabulary always splits, and ASCII capitals are folded
        first where no combining mark is near. A text with what may be an added token is only split at white space.
        """
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = (texts.buffers()[2] or pa.py_buffer(b""))[offsets[0] : offsets[-1]].to_pybytes()
        begins = offsets - offsets[0]
        if not raw:
            return np.array([], "<u4"), np.zeros(len(texts), np.int64)
        flat = np.frombuffer(raw, np.uint8)

        def whole(at: np.ndarray) -> np.ndarray:
            """Which bytes belong to a text that has one of the places ``at``."""
            hit = np.zeros(len(texts), bool)
            hit[np.searchsorted(begins, at, "right") - 1] = True
            return np.repeat(hit, np.diff(begins))

        kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
        folded = np.frombuffer(raw.translate(_FOLD), np.uint8) if self.folds else flat
        opens = np.zeros(len(flat) + 1, bool)  # where a word may begin
        opens[1:-1] = (kind[:-1] == _ALNUM) & (kind[1:] == _MARK)
        if b"\xcc" in raw or b"\xcd" in raw:  # first bytes of the combining marks
            folded = np.where(whole(np.flatnonzero((flat == 0xCC) | (flat == 0xCD))), flat, folded)
        if b"<|" in raw:
            marked = whole(np.flatnonzero((flat[:-1] == ord("<")) & (flat[1:] == ord("|"))))
            folded = np.where(marked, flat, folded)
            opens[:-1] &= ~marked
        solid = kind != _SPACE
        opens[begins] = True
        opens[1:] |= ~solid
        first = np.flatnonzero(opens[:-1] & solid)
        last = np.flatnonzero((opens[1:] | np.append(~solid[1:], True)) & solid)
        ends = np.cumsum(np.concatenate([[0], last + 1 - first]))
        kept = pa.py_buffer(folded[solid])
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), kept]).dictionary_encode()
        places = np.frombuffer(words.dictionary.buffers()[1], np.int64, len(words.dictionary) + 1).tolist()
        data = (words.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        at = words.indices.to_numpy()
        found = self._of([data[i:j] for i, j in zip(places, places[1:], strict=False)], np.bincount(at) > 1)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        counts = lengths[at]
        before = np.concatenate([[0], np.cumsum(counts)])
        place = np.repeat((np.cumsum(lengths) - lengths)[at] - before[:-1], counts) + np.arange(before[-1])
        of_text = before[np.searchsorted(first, begins)]
        return table[place], np.diff(of_text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ids, counts = self.encode(pa.array(raw, pa.binary()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary file; the library's own threads stay off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One partition in order: ids with the end id, and how many ids of the partition come before them."""
    own, before = word_encoder(path), 0
    for part in slices(batches, BATCH_ROWS, BATCH_BYTES):
        ids, counts = own.encode(part.column("_text"))
        ids = np.insert(ids, np.cumsum(counts), end_id)
        counts = counts + 1
        ends = np.cumsum(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view("<i4")))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("part"), pa.array(before + ends - counts), pa.array(counts), lists],
            ["doc_id", "part", "offset", "n_tokens", "ids"],
        )
        before += int(counts.sum())


def write_tokens(docs: DataFrame, vocabulary: str, path: str, *, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the ids to ``path`` in ascending key order.

    A range exchange on the key (ties broken by input position, so repeated rows and a hot key are
    dealt out too) orders the rows; each partition is encoded and written as one file by Spark's own
    committer, so a lost executor costs its tasks only. File names ascend with the key. Columns: doc_id,
    part (the file's number), offset (ids before the document in its file), n_tokens, ids.

    Null and empty texts get the end id alone; null keys come first; an empty table writes no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    order = ["doc_id", "_tie"]
    ranged = (
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "_text", F.spark_partition_id().alias("part"))
    )
    encoded = ranged.mapInArrow(
        lambda it: _encode(it, vocabulary, end_id), f"doc_id {kind}, part int, offset long, n_tokens long, ids array<int>"
    )
    encoded.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, low=None, high=None) -> DataFrame:
    """Rows of a token file with ``start``, the number of ids before each document over all files.

    ``columns`` prunes what is read (the metadata columns do not touch the ids' pages); ``low`` and
    ``high`` bound doc_id, which the page indexes turn into a read of a few pages.
    """
    files = spark.read.parquet(path)
    # One row a file, so the running sum and the broadcast are bounded by the number of files.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    bases = totals.select(
        F.col("part"),
        F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    rows = files
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    placed = rows.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("offset"))
    return placed.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        ends = lists.offsets.to_numpy().tolist()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_file_digests(docs: DataFrame, vocabulary: str, *, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the token files, read them back, and return doc_id, start, n_tokens and ids_crc32 per document."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, vocabulary, path, end_id=end_id)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_tokens(spark, path).mapInArrow(_checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")

"""Byte-level tokenizers: special tokens, distributed training counts, encoding."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.shared import materialise

if TYPE_CHECKING:
    from tokenizers import Tokenizer

# Fixed value: special tokens in the order of their ids.
SPECIAL_TOKENS = (
    "<pad>", "<bos>", "<eos>", "<unk>", "<think>", "</think>", "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>",
    "<code>", "</code>", "<|im_start|>", "<|im_end|>", "<FILL>", "<PREFIX>", "<SUFFIX>", "<search>", "<replace>", "<diff_end>",
    "<uncertain>", "<db_call>", "</db_call>",
)
#: A pre-token: an optional space and letters, digits or marks, or white space.
PRE_TOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Characters that are encoded in one go, and tokens that are decoded in one go.
TOGETHER = 1 << 20


def special_ids() -> dict[str, int]:
    return {t: k for k, t in enumerate(SPECIAL_TOKENS)}


def pre_token_counts(df: DataFrame, content: str, min_frequency: int = 2) -> DataFrame:
    """Pre-tokens and how often they occur, counted on the cluster: what merge learning needs of a corpus."""
    pieces = df.select(F.explode(F.regexp_extract_all(F.col(content), F.lit(PRE_TOKEN), F.lit(0))).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def _slices(sizes: Iterable[int]) -> Iterator[slice]:
    """Neighbours whose sizes sum up to :data:`TOGETHER` at most, or one that is larger."""
    low, total, at = 0, 0, 0
    for size in sizes:
        if at > low and total + size > TOGETHER:
            yield slice(low, at)
            low, total = at, 0
        at, total = at + 1, total + size
    if at > low:
        yield slice(low, at)


def encoded(own: Tokenizer, texts: pd.Series) -> Iterator[pd.Series]:
    """Ids of the texts, as parts of a series: the library keeps some 100 bytes a token until a part is done."""
    for part in _slices(0 if t is None else len(t) for t in texts):
        found = iter(own.encode_batch([t for t in texts[part] if t is not None], add_special_tokens=False))
        yield pd.Series([None if t is None else np.array(next(found).ids, np.int32) for t in texts[part]], dtype=object)


def encode(content: Column | str, path: str) -> Column:
    """Token ids by the tokenizer file at ``path``, which every executor must be able to read; null gives null."""

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _load(path)
        for part in texts:
            yield from encoded(own, part)

    return run(content)


def decode(ids: Column | str, path: str, skip_special: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _load(path)
        for whole in lists:
            for part in _slices(0 if x is None else len(x) for x in whole):
                yield whole[part].map(lambda x: None if x is None else own.decode(x.tolist(), skip_special_tokens=skip_special))

    return run(ids)


def encode_padded(df: DataFrame, content: str, path: str, longest: int = 32_768, pad: int = 0) -> DataFrame:
    """``df`` with ``ids`` cut to ``longest`` and padded to the longest of the table; encoded once, and written in between."""
    cut = materialise(df.withColumn("ids", F.slice(encode(content, path), 1, longest)), "encoded")
    width = cut.agg(F.coalesce(F.max(F.size("ids")), F.lit(0))).first()[0]
    return cut.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(width) - F.size("ids"))))

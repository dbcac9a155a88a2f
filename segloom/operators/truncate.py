"""Texts limited to a number of tokens, by words or by a tokenizer."""

from __future__ import annotations

import functools
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.scalar import first_words


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[int]) -> str: ...


class FileTokenizer:
    """A tokenizer of the `tokenizers` library from a file that workers can read."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Loaded
        from tokenizers import decoders

        self.inner = Loaded.from_file(path)
        suffix = getattr(self.inner.model, "end_of_word_suffix", None)
        if self.inner.decoder is None and suffix:  # the file says how words end, not how to join them
            self.inner.decoder = decoders.BPEDecoder(suffix=suffix)

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text).ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.inner.encode_batch_fast(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids, skip_special_tokens=True)


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    """Once for each Python worker."""
    return FileTokenizer(path)


def truncate_words(df: DataFrame, n: int | None, cols: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """Keeps the first n space-separated words of the columns that exist; null n changes nothing."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, first_words(F.col(c), n))
    return df


def truncate_tokens(df: DataFrame, n: int | None, path: str, cols: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """Keeps the first n tokens of the columns that exist, decoded without special tokens.

    A special token that the tokenizer adds at the start counts. Null texts stay null.
    """
    if n is None:
        return df

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        tokenizer = load_tokenizer(path)
        # each distinct text of a batch once, all together
        given = list({t for t in texts if isinstance(t, str)})
        short = {t: tokenizer.decode(ids[:n]) if len(ids) > n else t for t, ids in zip(given, tokenizer.encode_batch(given))}
        return pd.Series([short.get(t) if isinstance(t, str) else None for t in texts], dtype=object)

    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, cut(F.col(c)))
    return df

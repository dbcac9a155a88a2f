"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm import lexicon
from segloom.llm import tokenizers as T


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR) -> DataFrame:
    """Token ids of every text: (`id_col`, ids array<int>).

    Null and empty texts give an empty array, blank texts are encoded as they are, repeated
    rows each get their row, an empty table gives an empty result; other columns are ignored,
    whatever their names. Two passes over the texts: one counts the pieces for the lexicon,
    one encodes. Neither shuffles texts; the first shuffles distinct pieces with counts.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = lexicon.build(texts, ["text"], vocab, vocab_dir)

    def run(batches):
        words = lexicon.load(name)
        for batch in batches:
            for part in T.slices(batch, ["text"]):
                ids, offsets = lexicon.encode_column(part.column(1), words, vocab, vocab_dir)
                values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["id", "ids"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR) -> DataFrame:
    """The columns `keep` and n_tokens of each row; null and empty texts have 0 tokens."""
    texts = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    name = lexicon.build(texts, ["text"], vocab, vocab_dir)

    def run(batches):
        words = lexicon.load(name)
        for batch in batches:
            for part in T.slices(batch, ["text"]):
                _, offsets = lexicon.encode_column(part.column(len(keep)), words, vocab, vocab_dir)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(offsets).astype(np.int32))], [*part.schema.names[: len(keep)], "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]) + ", n_tokens int"
    out = texts.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")

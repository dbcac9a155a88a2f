"""Tokens of each text and totals by source, language and domain.

Distinct pieces of the corpus are sorted and range-partitioned, so each partition is a prefix
trie read depth first: a piece shares the states of its common prefix with the piece before.
The state of a prefix is the last token of its exact encoding and the number of tokens; it
follows from the states of shorter prefixes, since a sequence of tokens is the encoding of its
text exactly if each two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.langs import with_label_codes
from segloom.llm import tokenizers as T
from segloom.util import table


#: Pairs of neighbours that a task remembers.
MOST_PAIRS = 1 << 20
#: Keys that the rows of texts, which look up no piece, are spread over. No UTF-8 text has
#: their first byte, so they match no piece.
SPREAD = np.array([b"\xff" + i.to_bytes(2, "big") for i in range(1 << 12)], object)


class PrefixStates:
    """Exact incremental tokenization along pieces in sorted order."""

    def __init__(self, vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR):
        self.ranks = T.ranks(vocab, vocab_dir)
        self.encode = T.encoder(vocab, vocab_dir)._encode_single_piece
        self.suffixes = {t[i:] for t in self.ranks for i in range(len(t))}
        self.text = {i: t for t, i in self.ranks.items()}
        self.pair: dict[tuple[int, int], bool] = {}
        self.piece, self.last, self.count = b"", [-1], [0]

    def neighbours(self, a: int, b: int) -> bool:
        known = self.pair.get((a, b))
        if known is None:
            if len(self.pair) >= MOST_PAIRS:  # a bound on memory; results don't depend on it
                self.pair.clear()
            known = self.pair[a, b] = self.encode(self.text[a] + self.text[b]) == [a, b]
        return known

    def tokens(self, piece: bytes) -> int:
        """Number of tokens of the piece; states of the prefix shared with the last are kept."""
        same, most = 0, min(len(piece), len(self.piece))
        while same < most and piece[same] == self.piece[same]:
            same += 1
        del self.last[same + 1 :], self.count[same + 1 :]
        last, count, ranks, suffixes = self.last, self.count, self.ranks, self.suffixes
        for end in range(same + 1, len(piece) + 1):
            fits = []
            at = end - 1
            while at >= 0 and (part := piece[at:end]) in suffixes:
                if part in ranks:
                    fits.append((at, ranks[part]))
                at -= 1
            for at, token in reversed(fits):
                if at == 0 or self.neighbours(last[at], token):
                    last.append(token)
                    count.append(count[at] + 1)
                    break
            else:
                raise ValueError("no token fits; the vocabulary lacks single bytes")
        self.piece = piece
        return count[-1]


def piece_tokens(counts: DataFrame, vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR) -> DataFrame:
    """(piece, n, n_tokens) of (piece, n), through range-partitioned prefix tries."""

    def run(batches):
        states = PrefixStates(vocab, vocab_dir)
        for batch in batches:
            found = [states.tokens(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], ["piece", "n", "n_tokens"])

    return counts.repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(run, "piece binary, n bigint, n_tokens int")


def _parts(df: DataFrame, keep: list[str], text_cols: list[str], vocab: str, vocab_dir: str) -> DataFrame:
    """Rows (k0.., field, whole, n): partial token counts; whole marks one row for each text."""
    spark = df.sparkSession
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] + [F.col(c).alias(f"t{i}") for i, c in enumerate(text_cols)]
    texts = df.select(*cols)
    names = [f"t{i}" for i in range(len(text_cols))]
    known = table(piece_tokens(T.piece_counts(texts, names), vocab, vocab_dir), "piece-tokens")
    common = {bytes(p): t for p, t in T.frequent(known).select("piece", "n_tokens").collect()}  # at most 1 / FREQUENT_SHARE rows
    shared = spark.sparkContext.broadcast(common)
    width = len(keep)

    def run(batches):
        common = shared.value
        for batch in batches:
            for part in T.slices(batch, names):
                for f, name in enumerate(text_cols):
                    column = part.column(width + f)
                    data, offsets, counts = T.pieces(column)
                    row = np.repeat(np.arange(len(column)), counts)
                    first, inverse = T.unique_pieces(data, offsets) if len(offsets) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    raw, begin, end = data.tobytes(), offsets[:-1][first], offsets[1:][first]
                    tokens = np.array([common.get(raw[a:b], -1) for a, b in zip(begin, end)], np.int64)
                    each = tokens[inverse] if len(inverse) else np.zeros(0, np.int64)
                    total = np.bincount(row, np.maximum(each, 0), len(column)).astype(np.int64)
                    rare = np.flatnonzero(each < 0)
                    # one row for each text, then one for each occurrence of a rare piece
                    at = np.concatenate([np.arange(len(column)), row[rare]])
                    piece = T.gather(data, offsets[:-1][rare], np.diff(offsets)[rare])
                    piece = pa.concat_arrays([pa.array(SPREAD[np.random.randint(0, len(SPREAD), len(column))], pa.binary()), piece])
                    n = np.concatenate([total, np.ones(len(rare), np.int64)])
                    present = pa.concat_arrays([column.is_valid(), pa.nulls(len(rare), pa.bool_()).fill_null(False)])
                    taken = [c.take(pa.array(at)) for c in part.columns[:width]]
                    is_text = pa.array(np.arange(len(at)) < len(column))
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(np.full(len(at), name)), is_text, present, piece, pa.array(n)], [*[f"k{i}" for i in range(width)], "field", "is_text", "present", "piece", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:width])
    parts = texts.mapInArrow(run, f"{schema}, field string, is_text boolean, present boolean, piece binary, n bigint")
    joined = parts.join(known.select("piece", F.col("n_tokens").alias("each")), "piece", "left")
    return joined.select(*[f"k{i}" for i in range(width)], "field", (F.col("is_text") & F.col("present")).alias("whole"), F.when(F.col("is_text"), F.col("n")).otherwise(F.col("n") * F.col("each")).alias("n"))


def text_tokens(df: DataFrame, id_col: str = "seg_id", text_cols: tuple[str, ...] = ("src", "tgt"), vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR) -> DataFrame:
    """Tokens of each text: (`id_col`, field_name, n_tokens bigint).

    Null and empty texts have 0 tokens; rows with the same id are added up by field, so ids
    should be unique. Frequent pieces (at most 65,536, by their share of all) are counted where
    the text is read; only occurrences of rare pieces are shuffled, and none of those is a hot
    key; the rows of the texts themselves are spread over keys of their own. Other columns may have any names.
    """
    parts = _parts(df, [id_col], list(text_cols), vocab, vocab_dir)
    return parts.groupBy(F.col("k0").alias(id_col), F.col("field").alias("field_name")).agg(F.sum("n").alias("n_tokens"))


def token_budget(df: DataFrame, names: DataFrame | None = None, vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR) -> DataFrame:
    """Totals by source, language and domain of src and tgt.

    Columns origin, field_name, lang (code of the label of the field's side, null if it names
    no language of the table `names`), text_domain, n_texts (not null), n_tokens. Null origins and domains are
    slices of their own; null texts count for no text and no token.
    """
    coded = with_label_codes(df.select("origin", "text_domain", "src_lang", "tgt_lang", "src", "tgt"), names, src_code="src_lang", tgt_code="tgt_lang")
    parts = _parts(coded, ["origin", "text_domain", "src_code", "tgt_code"], ["src", "tgt"], vocab, vocab_dir)
    lang = F.when(F.col("field") == "src", F.col("k2")).otherwise(F.col("k3"))
    return parts.groupBy(F.col("k0").alias("origin"), F.col("field").alias("field_name"), lang.alias("lang"), F.col("k1").alias("text_domain")).agg(
        F.sum(F.col("whole").cast("bigint")).alias("n_texts"), F.sum("n").alias("n_tokens")
    )

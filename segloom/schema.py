"""Schemas of segments, labelled examples and pairs."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()

#: Input columns of the scorers, and the label columns of examples and pairs.
INPUT_COLS = ["src_lang", "tgt_lang", "src", "tgt"]
PAIR_INPUT_COLS = ["src_lang", "tgt_lang", "src", "tgt1", "tgt2"]
LABEL_COLS = ["score"]
PAIR_LABEL_COLS = ["tgt1_score", "tgt2_score"]
#: A source segment in one language pair: the key that candidates share.
GROUP_COLS = ["src_lang", "tgt_lang", "src"]

#: A line to be scored; score is text, since lines may quote it or hold anything else.
LINE = T.StructType([T.StructField(c, _S) for c in (*INPUT_COLS, "score")])
#: A labelled example.
EXAMPLE = T.StructType([*[T.StructField(c, _S) for c in INPUT_COLS], T.StructField("score", _D)])
#: Two candidates for one source.
PAIR = T.StructType([*[T.StructField(c, _S) for c in PAIR_INPUT_COLS], *[T.StructField(c, _D) for c in PAIR_LABEL_COLS]])
#: A term that a translation should use.
TERM = T.StructType([T.StructField("src", _S), T.StructField("tgt", _S), T.StructField("desc", _S), T.StructField("examples", T.ArrayType(_S))])
#: The short names of the seven criteria, 0 to 10 each.
CRITERIA = ["accuracy", "terminology", "fluency", "style", "locale", "technical", "cultural"]

"""Segments with normalised languages, the input of most other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.langs import looked_up


def normalize_languages(df: DataFrame, *cols: str, names: DataFrame | None = None) -> DataFrame:
    """Replaces language labels in any spelling by English names; unknown labels stay.

    One broadcast hash join for each column, on the table of languages `names` (or the short
    list of `functions.langs`).
    """
    for c in cols or ("src_lang", "tgt_lang"):
        df = looked_up(df, "__name", c, 1, names)
        df = df.withColumn(c, F.coalesce("__name", c)).drop("__name")
    return df


def examples(df: DataFrame, keep: list[str] | None = None, names: DataFrame | None = None) -> DataFrame:
    """Labelled examples: normalised languages, texts, finite score; other columns on request."""
    rows = df.where(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return normalize_languages(rows.select(*(keep or []), "src_lang", "tgt_lang", "src", "tgt", "score"), names=names)

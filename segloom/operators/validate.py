"""Checks of columns and scores, and the split into usable and rejected rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.scalar import parse_score
from segloom.schema import INPUT_COLS, LABEL_COLS


def missing_fields(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns that the frame lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def require_fields(df: DataFrame, required: Iterable[str] = (*INPUT_COLS, *LABEL_COLS)) -> DataFrame:
    """The frame itself; fails before anything runs if a required column is missing."""
    if missing := missing_fields(df, required):
        raise ValueError(f"Missing required fields: {', '.join(missing)}")
    return df


def scored_rows(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Adds `valid` and the parsed score as `value` (null where it isn't valid)."""
    value = parse_score(F.col(score_col).cast("string"))
    return df.withColumn("value", value).withColumn("valid", F.col("value").isNotNull())


def split_valid(df: DataFrame, score_col: str = "score") -> tuple[DataFrame, DataFrame]:
    """(rows with a valid score as a double, the other rows as they came)."""
    marked = scored_rows(df, score_col)
    good = marked.where("valid").withColumn(score_col, F.col("value")).drop("value", "valid")
    return good, marked.where("not valid").drop("value", "valid")


def require_scores(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Rows with their score as a double; the job fails on the first invalid score."""
    value = parse_score(F.col(score_col).cast("string"))
    wrong = F.raise_error(F.concat(F.lit("Invalid score value: "), F.coalesce(F.col(score_col).cast("string"), F.lit("null"))))
    return df.withColumn(score_col, F.when(value.isNotNull(), value).otherwise(wrong.cast("double")))

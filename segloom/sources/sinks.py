"""JSON lines out: in input order or as tasks finish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_line(*cols: str) -> Column:
    """A compact JSON object of the columns in their order; nulls are written as null."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_unordered(df: DataFrame, path: str, line_col: str | None = None, codec: str | None = None) -> None:
    """One object for each row, in whatever order tasks write them; `codec` compresses them."""
    lines = df.select((F.col(line_col) if line_col else json_line(*df.columns)).alias("value"))
    (lines.write.option("compression", codec) if codec else lines.write).mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, order: list[str], line_col: str | None = None, one_file: bool = False) -> None:
    """One object for each row, in the order of the columns `order`.

    Range-sorted part files whose names sort in input order, written in parallel. `one_file`
    streams the sorted partitions through one task into a single file.
    """
    lines = df.withColumn("__line", F.col(line_col) if line_col else json_line(*[c for c in df.columns if c not in order]))
    lines = lines.orderBy(*order).select(F.col("__line").alias("value"))
    if one_file:
        lines = df.withColumn("value", F.col(line_col) if line_col else json_line(*[c for c in df.columns if c not in order])).repartition(1).sortWithinPartitions(*order).select("value")
    lines.write.mode("overwrite").text(path)

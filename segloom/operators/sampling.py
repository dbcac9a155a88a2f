"""Seeded order and limits that don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def order_key(seed: int, *cols: Column | str) -> Column:
    """Pseudo-random order key of a row: md5 of the seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def shuffled(df: DataFrame, key: str, seed: int = SEED, limit: int | None = None) -> DataFrame:
    """Rows in seeded order; with a limit the first ones only, without a full sort."""
    if limit is not None and limit < 0:
        raise ValueError("max_examples must not be negative")
    out = df.orderBy(order_key(seed, key), key)
    return out if limit is None else out.limit(limit)

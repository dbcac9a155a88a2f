"""Scalar expressions; all are built-in columns, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, lo: float, hi: float) -> Column:
    """`v` limited to [lo, hi]; null stays null (least and greatest alone would drop it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(v, F.lit(hi))))


def finite(v: Column) -> Column:
    """True for a number that isn't null, NaN or infinite; never null."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def parse_score(text: Column) -> Column:
    """A score from its text: a finite number, true as 1 and false as 0; null otherwise."""
    plain = F.trim(text)
    number = F.when(plain.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    value = F.when(plain == "true", F.lit(1.0)).when(plain == "false", F.lit(0.0)).otherwise(number)
    return F.when(finite(value), value)


def hash_fraction(*cols: Column) -> Column:
    """A number below 2^32 from the md5 of the joined texts; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def hash_60(*cols: Column) -> Column:
    """A number below 2^60 from the md5 of the joined texts; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def first_words(text: Column, n: int | None) -> Column:
    """The first n pieces between single spaces; the text itself for null n."""
    if n is None:
        return text
    if n < 0:
        raise ValueError("the number of words must not be negative")
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")

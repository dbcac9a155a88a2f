"""Sample scores to one score: floor of the mean, or the reciprocal-rank-weighted average.

Nulls are dropped before clamping to [0, 100] (least and greatest skip nulls, so the other
order would turn a null into 100). No score at all gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

METHODS = ("mean", "RRWA")


def _clamped(scores: Column) -> Column:
    kept = F.filter(scores, lambda x: x.isNotNull())
    return F.transform(kept, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double"))))


def mean_of(scores: Column) -> Column:
    """Mean of an array of scores, rounded down."""
    kept = _clamped(scores)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.floor(total / F.size(kept)).cast("int")).otherwise(0)


def rrwa_of(scores: Column) -> Column:
    """Average of an array of scores in falling order, the r-th weighing 1/r, rounded."""
    ranked = F.sort_array(_clamped(scores), asc=False)
    weighed = F.aggregate(F.transform(ranked, lambda x, i: x / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    weights = F.aggregate(F.transform(ranked, lambda x, i: F.lit(1.0) / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(ranked), F.lit(0)) > 0, F.rint(weighed / weights).cast("int")).otherwise(0)


def aggregate_scores(method: str, scores: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"Unknown aggregation method: {method}")
    return mean_of(scores) if method == "mean" else rrwa_of(scores)


def combine(method: str, scores: list[int | None]) -> int:
    """The same for the samples of one prompt in a worker."""
    if method not in METHODS:
        raise ValueError(f"Unknown aggregation method: {method}")
    kept = sorted((min(100.0, max(0.0, float(s))) for s in scores if s is not None), reverse=True)
    if not kept:
        return 0
    weights = [1.0] * len(kept) if method == "mean" else [1.0 / rank for rank in range(1, len(kept) + 1)]
    value = sum(s * w for s, w in zip(kept, weights)) / sum(weights)
    return int(value) if method == "mean" else round(value)


def aggregate_rows(samples: DataFrame, id_col: str, score_col: str, method: str) -> DataFrame:
    """The same over rows of samples: (`id_col`, score int).

    The mean combines before its shuffle. RRWA counts equal scores first: a run of equal
    scores at ranks a+1..b weighs H(b) - H(a), with H the harmonic numbers, so a hot id sends
    at most 101 rows for integer scores, not all its samples.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown aggregation method: {method}")
    score = F.when(F.col(score_col).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(score_col).cast("double"))))
    if method == "mean":
        return samples.groupBy(id_col).agg(F.coalesce(F.floor(F.avg(score)), F.lit(0)).cast("int").alias("score"))
    runs = samples.groupBy(id_col, score.alias("s")).agg(F.count("*").alias("n"))
    last = F.sum(F.when(F.col("s").isNotNull(), F.col("n")).otherwise(0)).over(Window.partitionBy(id_col).orderBy(F.desc_nulls_last("s")))
    runs = runs.withColumn("b", last).withColumn("h", harmonic(F.col("b")) - harmonic(F.col("b") - F.col("n")))
    known = F.col("s").isNotNull()
    total = F.sum(F.when(known, F.col("s") * F.col("h"))) / F.sum(F.when(known, F.col("h")))
    return runs.groupBy(id_col).agg(F.coalesce(F.rint(total), F.lit(0.0)).cast("int").alias("score"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 1000, by its expansion beyond (exact to the last bits)."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(1000)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    x = n.cast("double")
    large = F.log(x) + F.lit(0.5772156649015329) + F.lit(0.5) / x - F.lit(1.0) / (F.lit(12.0) * x * x)
    return F.when(n <= 0, F.lit(0.0)).when(n <= 1000, small).otherwise(large)

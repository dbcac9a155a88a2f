"""Objectives over examples, pairs, languages and candidate programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.metrics import metric_for


def with_metric(df: DataFrame, objective: str, epsilon: float = 0.0) -> DataFrame:
    """Adds `metric`: from score and pred (tRMSE), or from the pair's columns (PA)."""
    metric = metric_for(objective, epsilon)
    if objective == "tRMSE":
        return df.withColumn("metric", metric(F.col("score"), F.col("pred").cast("double")))
    return df.withColumn("metric", metric(F.col("tgt1_score"), F.col("tgt2_score"), F.col("tgt1_pred").cast("double"), F.col("tgt2_pred").cast("double")))


def rollup_metric(df: DataFrame, *by: str) -> DataFrame:
    """Examples and mean metric for each value of `by`; one row if there is none."""
    return df.groupBy(*by).agg(F.count("metric").alias("n"), F.round(F.avg("metric"), 6).alias("objective"))

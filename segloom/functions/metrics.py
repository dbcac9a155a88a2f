"""Per-example metrics; higher is better."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trmse(gold: Column, pred: Column) -> Column:
    """1 - ((gold - pred) / 100)^2; null if either is null."""
    off = (gold - pred) / F.lit(100.0)
    return F.lit(1.0) - off * off


def pairwise_accuracy(gold1: Column, gold2: Column, pred1: Column, pred2: Column, epsilon: float = 0.0) -> Column:
    """1 if both differences agree in being above 0, or the gold one is within epsilon.

    A predicted tie counts as not above 0, so it agrees with a worse first candidate only.
    """
    gold, pred = gold1 - gold2, pred1 - pred2
    return F.when(F.abs(gold) <= epsilon, 1.0).when((gold > 0) == (pred > 0), 1.0).when(gold.isNotNull() & pred.isNotNull(), 0.0)


def pairwise_strict(gold1: Column, gold2: Column, pred1: Column, pred2: Column) -> Column:
    """1 if both differences have the same sign; a gold tie asks for a predicted tie."""
    return F.when(F.signum(gold1 - gold2) == F.signum(pred1 - pred2), 1.0).when((gold1 - gold2).isNotNull() & (pred1 - pred2).isNotNull(), 0.0)


def metric_for(objective: str, epsilon: float = 0.0) -> Callable[..., Column]:
    """The metric of an objective, tRMSE or PA."""
    if objective == "tRMSE":
        return trmse
    if objective == "PA":
        return lambda g1, g2, p1, p2: pairwise_accuracy(g1, g2, p1, p2, epsilon)
    raise ValueError(f"Unknown objective: {objective}")

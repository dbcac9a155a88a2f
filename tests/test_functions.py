import math
import random

import pytest
from pyspark.sql import functions as F

from segloom.functions import aggregates, metrics
from segloom.functions.langs import code_of, lang_code, lang_name
from segloom.functions.scalar import clip, first_words, parse_score


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(None).cast("double") if x is None else F.lit(float(x))


@pytest.mark.parametrize("v,lo,hi,want", [(0.5, 0, 1, 0.5), (-1, 0, 1, 0), (2, 0, 1, 1), (None, 0, 1, None)])
def test_clip(spark, v, lo, hi, want):
    assert one(spark, clip(lit(v), float(lo), float(hi))) == want


@pytest.mark.parametrize("text,want", [("80", 80), (" 1.5 ", 1.5), ("1e2", 100), ("true", 1), ("false", 0), ("NaN", None), ("inf", None), ("1e999", None), ("bad", None), ("", None), (None, None)])
def test_parse_score(spark, text, want):
    assert one(spark, parse_score(F.lit(text).cast("string"))) == want


def test_first_words(spark):
    assert one(spark, first_words(F.lit("a  b c"), 3)) == "a  b"
    assert one(spark, first_words(F.lit("a b"), 0)) == ""
    assert one(spark, first_words(F.lit("a b"), None)) == "a b"
    assert one(spark, first_words(F.lit(None).cast("string"), 2)) is None
    with pytest.raises(ValueError):
        first_words(F.lit("a"), -1)


@pytest.mark.parametrize("gold,pred,want", [(80, 80, 1.0), (100, 0, 0.0), (None, 3, None)])
def test_trmse(spark, gold, pred, want):
    assert one(spark, metrics.trmse(lit(gold), lit(pred))) == want


@pytest.mark.parametrize(
    "g1,g2,p1,p2,eps,want",
    [(80, 60, 70, 10, 0, 1), (20, 60, 70, 10, 0, 0), (50, 49.2, 1, 99, 1, 1), (81, 80.5, 10, 90, 1, 1), (81, 80.5, 10, 90, 0, 0), (60, 80, 50, 50, 0, 1), (80, 60, 50, 50, 0, 0), (50, 50, 1, 2, -1, 1), (50, 50, 2, 1, -1, 0), (None, 1, 1, 2, 0, None)],
)
def test_pairwise(spark, g1, g2, p1, p2, eps, want):
    assert one(spark, metrics.metric_for("PA", eps)(lit(g1), lit(g2), lit(p1), lit(p2))) == want


def test_strict(spark):
    assert one(spark, metrics.pairwise_strict(lit(50), lit(50), lit(50), lit(50))) == 1
    assert one(spark, metrics.pairwise_strict(lit(50), lit(50), lit(50), lit(51))) == 0


def test_unknown_objective():
    with pytest.raises(ValueError, match="Unknown objective"):
        metrics.metric_for("x")


def plain(scores, method):
    kept = [max(0, min(100, s)) for s in scores if s is not None]
    if not kept:
        return 0
    if method == "mean":
        return math.floor(sum(kept) / len(kept))
    kept.sort(reverse=True)
    return round(sum(s / (r + 1) for r, s in enumerate(kept)) / sum(1 / (r + 1) for r in range(len(kept))))


def test_aggregation(spark):
    rng = random.Random(1)
    cases = [[], [None], [50], [100, 0], [-5, 130, None]] + [[rng.choice([None, rng.randint(-20, 130)]) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, s array<int>")
    got = df.select("id", aggregates.mean_of(F.col("s")).alias("m"), aggregates.rrwa_of(F.col("s")).alias("r")).collect()
    assert {r.id: (r.m, r.r) for r in got} == {i: (plain(c, "mean"), plain(c, "RRWA")) for i, c in enumerate(cases)}
    assert [plain(c, "RRWA") for c in cases[:5]] == [0, 0, 50, 67, 67]
    rows = df.where("size(s) > 0").select("id", F.explode("s").alias("score"))
    for method in aggregates.METHODS:
        out = {r.id: r.score for r in aggregates.aggregate_rows(rows, "id", "score", method).collect()}
        assert out == {i: plain(c, method) for i, c in enumerate(cases) if c}
    with pytest.raises(ValueError):
        aggregates.aggregate_scores("median", F.col("s"))


def test_many_samples_of_one_id(spark):
    """Equal scores are counted, so a hot id is a few rows; ranks beyond 1000 by expansion."""
    rows = spark.range(5000).select(F.lit(1).alias("id"), (F.col("id") % 7 * 10).cast("int").alias("score"))
    want = plain([i % 7 * 10 for i in range(5000)], "RRWA")
    assert aggregates.aggregate_rows(rows, "id", "score", "RRWA").first().score == want


@pytest.mark.parametrize("label,code", [("en", "en"), (" EN\t", "en"), ("en-GB", "en"), ("pt_BR", "pt"), ("ger", "de"), ("Czech", "cs"), ("JAPANESE", "ja"), ("xx", None), ("", None), (None, None), ("en-", None)])
def test_languages(spark, label, code):
    assert one(spark, lang_code(F.lit(label).cast("string"))) == code
    assert code_of(label) == code
    if code is None:
        assert one(spark, lang_name(F.lit(label).cast("string"))) == label

"""Queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.functions import aggregates, metrics
from segloom.functions.scalar import clip
from segloom.operators import evaluate, pairs, sampling, truncate, validate
from segloom.operators.normalize import examples, normalize_languages
from segloom.schema import CRITERIA, INPUT_COLS
from segloom.scoring.offline import HashScorer, LengthRatio
from segloom.scoring.predict import map_rows, predict, sample_rows, score_pairs, score_segments
from segloom.sources.jsonl import parse_lines, read_lines
from segloom.sources.sinks import json_line, write_ordered
from segloom.streaming.predict import score_stream
from segloom.training import optimize
from segloom.training.program import Program
from segloom.util import run_dir, table

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments(spark, folder, keep=("seg_id",)) -> DataFrame:
    return examples(read(spark, folder, "segments"), list(keep), names=read(spark, folder, "lang_names"))


def scratch(spark, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


# sources and sinks


def scan_jsonl(spark, folder):
    """Kinds of the raw lines of each file, and how many have a score."""
    parsed = parse_lines(read(spark, folder, "da_lines"))
    return parsed.groupBy("file_name", "kind").agg(F.count("*").alias("n_lines"), F.count("score").alias("n_scores"))


def scan_da(spark, folder):
    """Labelled examples of the raw lines: five fields, normalised languages."""
    parsed = parse_lines(read(spark, folder, "da_lines")).where("kind = 'ok' and src is not null and tgt is not null and score is not null")
    return normalize_languages(parsed.select("line_id", *INPUT_COLS, "score"), names=read(spark, folder, "lang_names"))


def sink_roundtrip(spark, folder):
    """Segments written as ordered JSON lines and read again."""
    path = scratch(spark, "roundtrip")
    write_ordered(read(spark, folder, "segments").select("seg_id", F.col("seg_id").alias("id"), *INPUT_COLS, "score"), path, ["seg_id"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", *INPUT_COLS, "score")])
    back = parse_lines(read_lines(spark, path), schema=schema)
    return back.select(F.col("id").cast("bigint").alias("seg_id"), *INPUT_COLS, "score")


def fan_out(spark, folder):
    """A Python function that gives 0, 1 or 2 rows for a row."""
    rows = read(spark, folder, "segments").select("seg_id")
    return map_rows(rows, lambda r: [{"seg_id": r["seg_id"], "part": p} for p in range(r["seg_id"] % 3)], "seg_id bigint, part int")


def stream_scores(spark, folder):
    """JSON lines scored by the streaming query, read from its sink."""
    source, sink, mark = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    read(spark, folder, "split_examples").select(json_line(*INPUT_COLS).alias("value")).write.text(source)
    score_stream(spark, source, sink, mark, "DA", HashScorer()).awaitTermination()
    parsed = parse_lines(spark.read.text(sink).select(F.col("value").alias("raw")))
    return parsed.select(*INPUT_COLS, F.col("score").cast("int").alias("score"))


# projections, validation, order


def normalize_lang(spark, folder):
    labels = read(spark, folder, "segments").select("src_lang", "tgt_lang")
    return normalize_languages(labels, names=read(spark, folder, "lang_names")).groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("n"))


def validate_schema(spark, folder):
    """Required fields that each table lacks."""
    need = (*INPUT_COLS, "score")
    rows = [(t, ", ".join(validate.missing_fields(read(spark, folder, t), need))) for t in ("segments", "split_examples", "score_samples", "documents")]
    return spark.createDataFrame(rows, "table_name string, missing string")


def validate_score(spark, folder):
    marked = validate.scored_rows(read(spark, folder, "segments").select("origin", F.col("score").cast("string").alias("score")))
    return marked.groupBy("origin", "valid").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def shuffle_limit(spark, folder):
    return sampling.shuffled(read(spark, folder, "documents").select("doc_id", "source"), "doc_id", limit=100)


def truncate_words(spark, folder):
    return truncate.truncate_words(read(spark, folder, "documents").select("doc_id", "text"), 12, ("text",))


def truncate_tokens(spark, folder):
    return truncate.truncate_tokens(read(spark, folder, "segments").select("seg_id", "src", "tgt"), 16, TOKENIZER)


def clip_scores(spark, folder):
    return read(spark, folder, "segments").where("not isnan(score)").select("seg_id", clip(F.col("score"), 20.0, 80.0).alias("clipped"))


# groups and pairs


def group_sources(spark, folder):
    return pairs.group_sizes(segments(spark, folder), ordered=True)


def group_filter(spark, folder):
    return pairs.group_sizes(segments(spark, folder)).where("n_candidates >= 2")


def pairs_all(spark, folder):
    return pairs.all_pairs(segments(spark, folder)).select("id1", "id2", "tgt1_score", "tgt2_score")


def pairs_topk(spark, folder):
    return pairs.k_pairs(segments(spark, folder), 2).select("id1", "id2", "tgt1_score", "tgt2_score")


def pairs_limit(spark, folder):
    return pairs.limit_pairs(pairs.k_pairs(segments(spark, folder), 8), 50).select("id1", "id2")


def pairs_sequential(spark, folder):
    return pairs.sequential_pairs(segments(spark, folder), 2).select("id1", "id2")


# scores


def score_da(spark, folder):
    return score_segments(segments(spark, folder), "DA", HashScorer()).select("seg_id", "score")


def score_length(spark, folder):
    return score_segments(segments(spark, folder), "DA", LengthRatio()).select("seg_id", "score")


def score_worker(spark, folder):
    """The same scorer behind the Python boundary: distinct prompts, batches, join back."""

    class Boundary:
        def score_batch(self, prompts, sample):
            return HashScorer().score_batch(prompts, sample)

    return score_segments(segments(spark, folder), "DA", Boundary()).select("seg_id", "score")


def score_mr7(spark, folder):
    return score_segments(segments(spark, folder), "MR7", HashScorer(), keep_subscores=True).select("seg_id", "score", *[f"{c}_score" for c in CRITERIA])


def score_mr7mean(spark, folder):
    return score_segments(segments(spark, folder), "MR7MEAN", HashScorer()).select("seg_id", "score")


def score_mr7rrwa(spark, folder):
    return score_segments(segments(spark, folder), "MR7RRWA", HashScorer()).select("seg_id", "score")


def sample_fanout(spark, folder):
    return sample_rows(segments(spark, folder), 10, HashScorer()).select("seg_id", "sample_id", "sample_score")


def score_override(spark, folder):
    rows = segments(spark, folder, ("seg_id", "system_name", "origin"))
    return predict(rows, "DA", HashScorer(), 20).select("seg_id", "system_name", "origin", "src", "tgt", "score")


def agg_mean(spark, folder):
    return aggregates.aggregate_rows(read(spark, folder, "score_samples"), "seg_id", "score", "mean")


def agg_rrwa(spark, folder):
    return aggregates.aggregate_rows(read(spark, folder, "score_samples"), "seg_id", "score", "RRWA")


def agg_arrays(spark, folder):
    """Both aggregations over arrays of samples (ten for a segment, some delivered twice)."""
    grouped = read(spark, folder, "score_samples").groupBy("seg_id").agg(F.collect_list(F.struct("score")).alias("s"))
    scores = F.transform("s", lambda x: x["score"])
    return grouped.select("seg_id", aggregates.mean_of(scores).alias("mean_score"), aggregates.rrwa_of(scores).alias("rrwa_score"))


def terminology(spark, folder):
    """Segments with a list of terms (by the key of a region), scored with them."""
    terms = read(spark, folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    entry = lambda n: F.struct(n.alias("src"), F.lower(n).alias("tgt"), F.lit("").alias("desc"), F.array().cast("array<string>").alias("examples"))
    terms = terms.select("n_regionkey", F.transform("names", entry).alias("terminology"))
    rows = segments(spark, folder).withColumn("n_regionkey", (F.col("seg_id") % 6).cast("int")).join(terms, "n_regionkey", "left")
    rows = rows.withColumn("terminology", F.coalesce("terminology", F.array().cast(terms.schema["terminology"].dataType)))
    scored = score_segments(rows, "DATERM", HashScorer("term"))
    return scored.select("seg_id", F.size("terminology").alias("n_terms"), "score")


# metrics and evaluation


def _scored_pairs(spark, folder) -> DataFrame:
    return score_pairs(pairs.k_pairs(segments(spark, folder), 4), "DA", HashScorer())


def pairwise_score(spark, folder):
    return _scored_pairs(spark, folder).select("id1", "id2", "tgt1_pred", "tgt2_pred")


def metric_trmse(spark, folder):
    rows = segments(spark, folder).withColumn("pred", HashScorer().column({c: F.col(c) for c in INPUT_COLS}))
    return evaluate.with_metric(rows, "tRMSE").select("seg_id", F.round("metric", 9).alias("metric"))


def metric_pa(spark, folder):
    return evaluate.with_metric(_scored_pairs(spark, folder), "PA").select("id1", "id2", "metric")


def metric_pa_eps(spark, folder):
    return evaluate.with_metric(_scored_pairs(spark, folder), "PA", 5.0).select("id1", "id2", "metric")


def metric_pa_strict(spark, folder):
    strict = metrics.pairwise_strict(F.col("tgt1_score"), F.col("tgt2_score"), F.col("tgt1_pred").cast("double"), F.col("tgt2_pred").cast("double"))
    return _scored_pairs(spark, folder).select("id1", "id2", strict.alias("metric"))


def eval_by_lang(spark, folder):
    """The flagship: score, compare with the gold score, roll up by language."""
    rows = segments(spark, folder).withColumn("pred", LengthRatio().column({c: F.col(c) for c in INPUT_COLS}))
    return evaluate.rollup_metric(evaluate.with_metric(rows, "tRMSE"), "tgt_lang")


def eval_pairs_by_lang(spark, folder):
    return evaluate.rollup_metric(evaluate.with_metric(_scored_pairs(spark, folder), "PA"), "tgt_lang")


def eval_samples(spark, folder):
    """Aggregated samples against the gold score of their segment, by system."""
    gold = read(spark, folder, "segments").where("score is not null and not isnan(score)").select("seg_id", "system_name", "score")
    pred = agg_rrwa(spark, folder).withColumnRenamed("score", "pred")
    return evaluate.rollup_metric(evaluate.with_metric(gold.join(pred, "seg_id"), "tRMSE"), "system_name")


def eval_by_candidate(spark, folder):
    return optimize.evaluate(segments(spark, folder), [0, 1, 2, 3], _candidate, "tRMSE")


def _candidate(number, inputs):
    return HashScorer(f"program{number}").column(inputs)


def _search(spark, folder, name, objective):
    config = optimize.TrainingConfig(objective, pairs_per_source=4)
    train, _ = optimize.load_sets(segments(spark, folder), None, config)
    train = table(train, "train")
    programs = optimize.propose(Program.new("DA"), optimize.demonstrations(train, objective, 8), 6)
    return optimize.OPTIMIZERS[name](programs, train, None, _candidate, config)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        eval_by_lang, scan_jsonl, scan_da, sink_roundtrip, fan_out, stream_scores, normalize_lang, validate_schema, validate_score, shuffle_limit,
        clip_scores, group_sources, group_filter, pairs_all, pairs_topk, pairs_limit, pairs_sequential, score_da, score_length,
        score_worker, score_mr7, score_mr7mean, score_mr7rrwa, sample_fanout, score_override, agg_mean, agg_rrwa, agg_arrays, terminology,
        pairwise_score, metric_trmse, metric_pa, metric_pa_eps, metric_pa_strict, eval_pairs_by_lang, eval_samples, eval_by_candidate,
    ]
    out = {f.__name__: f for f in plain}
    out["truncate"] = truncate_words
    out["truncate_tokens"] = truncate_tokens
    out["search_mipro"] = lambda s, d: _search(s, d, "MIPROv2", "tRMSE")
    out["search_simba"] = lambda s, d: _search(s, d, "SIMBA", "PA")
    return out

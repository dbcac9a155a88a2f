"""Scoring of whole tables: each distinct prompt once, samples in parallel, failures marked."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from segloom.functions.aggregates import aggregate_rows
from segloom.operators.truncate import truncate_tokens, truncate_words
from segloom.schema import INPUT_COLS
from segloom.scoring.architectures import Architecture, architecture
from segloom.scoring.base import Scorer, retried
from segloom.util import digest, parallelism, table


def _inputs(cols=INPUT_COLS):
    return {c: F.col(c) for c in cols}


def sample_rows(df: DataFrame, n: int, scorer) -> DataFrame:
    """n rows for each row, with `sample_id` 0.. and the `sample_score` of an expression scorer."""
    if n < 1:
        raise ValueError("num_samples must be >= 1")
    out = df.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("sample_score", scorer.column(_inputs(), F.col("sample_id")))


def map_rows(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """A user's function from a row to any number of rows, in batches.

    An error in the function fails the task; a function that returns [] drops the row.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [out for row in batch.to_dict("records") for out in fn(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def _scored_by_worker(prompts: DataFrame, arch: Architecture, scorer: Scorer, batch: int) -> DataFrame:
    """(prompt, sample_id, score, subscores, error) of prompts (prompt, inputs, sample_id)."""
    schema = "prompt binary, sample_id int, score int, subscores string, error string"
    if hasattr(scorer, "shared_by"):
        # as many tasks as may share the limit: however many executors there are, no more
        # requests than it run at a time
        tasks = max(1, min(parallelism(prompts.sparkSession), scorer.max_concurrent))
        prompts, scorer = prompts.repartition(tasks), scorer.shared_by(tasks)

    def run(batches):
        for rows in batches:
            for sample, part in rows.groupby("sample_id"):
                for begin in range(0, len(part), batch):
                    some = part.iloc[begin : begin + batch]
                    inputs = some[arch.signature.inputs].to_dict("records")
                    try:
                        results = scorer.score_batch(inputs, int(sample))
                    except Exception:  # noqa: BLE001  one by one, so that one bad row costs one score
                        results = [retried(lambda p=p: scorer.score_batch([p], int(sample))[0]) for p in inputs]
                    yield pd.DataFrame({"prompt": some["prompt"], "sample_id": int(sample), "score": pd.array([r.score for r in results], "Int32"), "subscores": [json.dumps(r.subscores) if r.subscores else None for r in results], "error": [r.error for r in results]})

    return prompts.mapInPandas(run, schema)


def _cached(prompts: DataFrame, arch: Architecture, scorer: Scorer, batch: int, cache: str) -> DataFrame:
    """Answers to the prompts: those in the folder `cache` as they are, others asked for and,
    unless they failed, added to it."""
    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", digest(F.lit(scorer.fingerprint()), F.col("prompt"), F.col("sample_id")))
    try:
        old = spark.read.schema("key binary, score int, subscores string").parquet(cache).dropDuplicates(["key"])
    except AnalysisException:  # no folder yet
        return _kept(_scored_by_worker(prompts, arch, scorer, batch), keyed, cache)
    known = table(keyed.select("key", "prompt", "sample_id").join(old, "key").select("prompt", "sample_id", "score", "subscores", F.lit(None).cast("string").alias("error")), "cached")
    new = keyed.join(old, "key", "left_anti")
    return known.unionByName(_kept(_scored_by_worker(new.drop("key"), arch, scorer, batch), new, cache))


def _kept(answers: DataFrame, keyed: DataFrame, cache: str) -> DataFrame:
    answers = table(answers, "scores")
    good = answers.where("error is null").join(keyed.select("key", "prompt", "sample_id"), ["prompt", "sample_id"])
    good.select("key", "score", "subscores").write.mode("append").parquet(cache)
    return answers


def score_segments(df: DataFrame, arch_name: str, scorer, keep_subscores: bool = False, batch: int = 512, config: dict | None = None, cache: str | None = None) -> DataFrame:
    """All columns of `df` with `score` set (an existing score is overwritten) and `error`.

    An expression scorer runs in the JVM. Another one gets each distinct prompt once; its
    answers are written before they are used, so a lost task repeats its own prompts only and
    nothing is asked twice for one result. Only the input columns reach the scorer. A failed
    sample counts as 0; `error` then has the first message. `config` (of a saved program)
    replaces number, temperature and aggregation of the samples. `cache` is a folder of answers
    that later runs use again.
    """
    arch = architecture(arch_name).configured(config)
    if hasattr(scorer, "column"):
        own = _inputs(arch.signature.inputs)
        if arch.num_samples == 1 and not arch.method:
            out = df.withColumn("score", scorer.column(own, None))
            if keep_subscores and arch.subscores and hasattr(scorer, "subscore"):
                for c in arch.subscores:
                    out = out.withColumn(f"{c}_score", scorer.subscore(c, own))
            return out.withColumn("error", F.lit(None).cast("string"))
        from segloom.functions.aggregates import aggregate_scores

        samples = F.array(*[scorer.column(own, F.lit(i)) for i in range(arch.num_samples)])
        return df.withColumn("score", aggregate_scores(arch.method, samples)).withColumn("error", F.lit(None).cast("string"))
    inputs = arch.signature.inputs
    texts = [F.to_json(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType)) else F.col(c) for c in inputs]
    keyed = df.withColumn("__prompt", digest(*texts))
    prompts = keyed.select(F.col("__prompt").alias("prompt"), *inputs).dropDuplicates(["prompt"])
    prompts = prompts.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(arch.num_samples - 1))))
    if cache and hasattr(scorer, "fingerprint"):
        answers = _cached(prompts, arch, scorer, batch, cache)
    else:
        answers = table(_scored_by_worker(prompts, arch, scorer, batch), "scores")
    first_error = F.min_by("error", "sample_id").alias("error")
    if not arch.method:
        one = answers.select("prompt", "score", "subscores", "error")
    else:
        one = aggregate_rows(answers, "prompt", "score", arch.method).join(answers.groupBy("prompt").agg(first_error), "prompt").withColumn("subscores", F.lit(None).cast("string"))
    out = keyed.drop("score", "error").join(one.withColumnRenamed("prompt", "__prompt"), "__prompt").drop("__prompt")
    if keep_subscores and arch.subscores:
        read = F.from_json("subscores", "map<string,int>")
        for c in arch.subscores:
            out = out.withColumn(f"{c}_score", read[c])
    return out.drop("subscores")


def score_pairs(pairs: DataFrame, arch_name: str, scorer, config: dict | None = None) -> DataFrame:
    """Pairs with tgt1_pred and tgt2_pred: each distinct candidate is scored once, then joined
    back to both sides."""
    if hasattr(scorer, "column"):
        for side in ("tgt1", "tgt2"):
            scored = score_segments(pairs.withColumn("tgt", F.col(side)).drop("error"), arch_name, scorer, config=config)
            pairs = scored.withColumnRenamed("score", f"{side}_pred").drop("tgt", "error")
        return pairs
    base = ["src_lang", "tgt_lang", "src"]
    both = pairs.select(*base, F.explode(F.array("tgt1", "tgt2")).alias("tgt")).distinct()
    scored = table(score_segments(both, arch_name, scorer, config=config).select(digest(*base, "tgt").alias("k"), "score"), "pair-scores")
    for side in ("tgt1", "tgt2"):
        pairs = pairs.withColumn("k", digest(*base, side)).join(scored.withColumnRenamed("score", f"{side}_pred"), "k").drop("k")
    return pairs


def predict(df: DataFrame, arch_name: str, scorer, max_segment_tokens: int | None = None, tokenizer: str | None = None, config: dict | None = None, cache: str | None = None) -> DataFrame:
    """The prediction pipeline: truncate src and tgt, score, keep every input column."""
    cut = truncate_tokens(df, max_segment_tokens, tokenizer) if tokenizer else truncate_words(df, max_segment_tokens)
    return score_segments(cut, arch_name, scorer, config=config, cache=cache)

"""Command line: train-da and predict-da."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys

import pandas as pd

from segloom.scoring.architectures import ARCHITECTURES
from segloom.scoring.base import ScorerConfig


def json_option(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"not valid JSON: {e}") from e
    if not isinstance(value, dict):
        raise argparse.ArgumentTypeError("a JSON object is needed")
    return value


def at_least(least: int):
    def parse(text: str) -> int:
        if (value := int(text)) < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    env = os.environ.get
    p = argparse.ArgumentParser("segloom")
    p.add_argument("--model", default=env("SEGLOOM_MODEL"))
    p.add_argument("--scorer", choices=["http", "hash", "length"], default="http", help="offline scorers need no endpoint")
    p.add_argument("--api-base", default=env("SEGLOOM_API_BASE"))
    p.add_argument("--api-key", help="for the endpoint; by default from SEGLOOM_API_KEY or OPENAI_API_KEY of the workers")
    p.add_argument("--languages", help="table of languages (Parquet: lang_code, alpha3, alpha3_b, lang_name)")
    p.add_argument("--response-cache", help="folder that keeps answers between runs")
    p.add_argument("--enable-disk-cache", action=argparse.BooleanOptionalAction, default=False, help="keep answers in the shared folder, if --response-cache names no other")
    p.add_argument("--max-tokens", type=at_least(1), default=int(env("SEGLOOM_MAX_TOKENS", "2048")))
    p.add_argument("--max-concurrent", type=at_least(1), default=100)
    p.add_argument("--sampling-params", type=json_option, default={})
    p.add_argument("--no-ssl-verify", action="store_true")
    p.add_argument("--http-timeout", type=float, default=6000.0)
    p.add_argument("--progress", action=argparse.BooleanOptionalAction, default=True, help="show the progress of stages on standard error")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train-da")
    t.add_argument("--training-data", required=True)
    t.add_argument("--training-data-max-examples", type=at_least(0))
    t.add_argument("--validation-data")
    t.add_argument("--validation-data-max-examples", type=at_least(0))
    t.add_argument("--optimizer", choices=["MIPROv2", "SIMBA"], default="MIPROv2")
    t.add_argument("--optimizer-params", type=json_option, default={})
    t.add_argument("--optimizer-compile-params", type=json_option, default={})
    t.add_argument("--objective", choices=["tRMSE", "PA"], default="tRMSE")
    t.add_argument("--pairwise-k-per-source", type=at_least(1), default=8)
    t.add_argument("--pairwise-epsilon", type=float, default=0.0)
    t.add_argument("--output", required=True)
    t.add_argument("--architecture", choices=sorted(ARCHITECTURES), default="DA")
    t.add_argument("--initial-program")
    r = sub.add_parser("predict-da")
    r.add_argument("--architecture", choices=sorted(ARCHITECTURES), default="DA")
    r.add_argument("--trained-model")
    r.add_argument("--tokenizer", help="path of a tokenizer file; without it, words are counted")
    r.add_argument("--max-segment-tokens", type=at_least(0))
    r.add_argument("--normalize-languages", action="store_true")
    r.add_argument("--output", default="-")
    r.add_argument("--rejects", help="folder for the lines that can't be scored, with the reason")
    r.add_argument("input_file", nargs="?", default="-")
    return p


def scorer_of(args, signature, program=None, temperature=0.5):
    from segloom.scoring.http import HttpScorer
    from segloom.scoring.offline import HashScorer, LengthRatio

    if args.scorer != "http":
        return HashScorer() if args.scorer == "hash" else LengthRatio()
    if not args.model:
        raise SystemExit("--model is needed for an endpoint")
    config = ScorerConfig(args.model, args.api_base, max_tokens=args.max_tokens, max_concurrent=args.max_concurrent, timeout=args.http_timeout, verify_tls=not args.no_ssl_verify, sampling=args.sampling_params)
    return HttpScorer(signature, config, program, temperature)


def cache_of(args, spark) -> str | None:
    from segloom.util import shared_dir

    if args.response_cache:
        return args.response_cache
    return f"{shared_dir(spark)}/segloom-answers" if args.enable_disk_cache else None


def predict_da(args, spark, out) -> None:
    from pyspark.sql import functions as F

    from segloom.operators.normalize import normalize_languages
    from segloom.scoring.architectures import architecture
    from segloom.scoring.predict import predict
    from segloom.sources.jsonl import parse_lines, read_lines, spool_stdin
    from segloom.sources.sinks import write_ordered, write_unordered
    from segloom.training.program import Program
    from segloom.util import table

    program = Program.load(args.trained_model, args.architecture) if args.trained_model else None
    arch = architecture(args.architecture).configured(program.config if program else None)
    scorer = scorer_of(args, arch.signature, program.state() if program else None, arch.sampling_temperature)
    path = spool_stdin(spark) if args.input_file == "-" else args.input_file
    parsed = table(parse_lines(read_lines(spark, path)), "input")
    usable = F.coalesce((F.col("kind") == "ok") & F.col("src").isNotNull() & F.col("tgt").isNotNull(), F.lit(False))
    rows = parsed.where(usable).drop("kind")
    if args.normalize_languages:
        rows = normalize_languages(rows, names=spark.read.parquet(args.languages) if args.languages else None)
    scored = predict(rows, args.architecture, scorer, args.max_segment_tokens, args.tokenizer, config=program.config if program else None, cache=cache_of(args, spark))
    scored = table(scored, "scored")
    # the line keeps its own keys and their order; src, tgt and score are set
    merged = scored.withColumn("line", merge_line(F.col("raw"), F.col("src"), F.col("tgt"), F.col("score")))
    if args.output != "-":
        write_ordered(merged.select("ordinal", "line"), args.output, ["ordinal"], "line")
    else:
        for row in merged.orderBy("ordinal").select("line").toLocalIterator():
            print(row.line, file=out)
    reason = F.when(F.col("kind") != "ok", F.col("kind")).when(F.col("src").isNull(), "no src").otherwise("no tgt")
    rejected = parsed.where(~usable & (F.col("kind") != "blank")).select("raw", reason.alias("reason"))
    if args.rejects:
        write_unordered(rejected, args.rejects)
    for r in rejected.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect():
        print(f"{r.n} lines rejected: {r.reason}", file=sys.stderr)
    failed = scored.where("error is not null").count()
    print(f"{scored.count()} lines scored, {failed} of them with an error and score 0", file=sys.stderr)


def merge_line(raw, src, tgt, score):
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def merge(raw: pd.Series, src: pd.Series, tgt: pd.Series, score: pd.Series) -> pd.Series:
        out = []
        for line, s, t, n in zip(raw, src, tgt, score):
            record = json.loads(line)
            record |= {"src": s, "tgt": t, "score": int(n)}
            out.append(json.dumps(record, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out)

    return merge(raw, src, tgt, score)


def train_da(args, spark, out) -> None:
    from pyspark.sql import functions as F

    from segloom.functions.aggregates import aggregate_scores
    from segloom.operators.normalize import normalize_languages
    from segloom.scoring.architectures import architecture
    from segloom.scoring.offline import HashScorer, LengthRatio
    from segloom.sources.jsonl import load_examples
    from segloom.training import optimize
    from segloom.training.program import Program
    from segloom.util import table

    names = spark.read.parquet(args.languages) if args.languages else None

    def load(path):
        try:
            good = load_examples(spark, path)
        except ValueError as e:
            raise SystemExit(f"{path}: {e}") from e
        return table(normalize_languages(good.withColumnRenamed("ordinal", "seg_id"), names=names), "examples")

    options = optimize.search_options(args.optimizer, args.optimizer_params, args.optimizer_compile_params)
    for name in options.pop("unknown"):
        print(f"{args.optimizer} has no parameter {name}", file=sys.stderr)
    config = optimize.TrainingConfig(args.objective, args.training_data_max_examples, args.validation_data_max_examples, args.pairwise_k_per_source, args.pairwise_epsilon, options)
    train, validation = optimize.load_sets(load(args.training_data), load(args.validation_data) if args.validation_data else None, config)
    train = table(train, "train")
    base = Program.load(args.initial_program, args.architecture) if args.initial_program else Program.new(args.architecture)
    demos, instructions = optimize.demonstrations(train, args.objective, 16), []
    if args.scorer == "http" and options["instructions"]:
        writer = scorer_of(args, architecture(args.architecture).signature)
        instructions = optimize.ask_for_instructions(writer.complete, base, demos, options["instructions"])
    programs = optimize.propose(base, demos, options["num_candidates"], options["seed"], options["per_program"], instructions)
    if args.scorer == "http":
        # no more tasks than requests that may run at a time
        train, validation = (x.coalesce(optimize.request_tasks(args, spark)) if x is not None else None for x in (train, validation))
        predict = optimize.asked(programs, args, train)
    else:

        def predict(p, inputs):
            # the offline hash tells programs apart, lengths are the same for all of them
            scorer = HashScorer(f"program{p}") if args.scorer == "hash" else LengthRatio()
            arch = architecture(args.architecture).configured(programs[p].config)
            if not arch.method:
                return scorer.column(inputs, F.lit(0))
            return aggregate_scores(arch.method, F.array(*[scorer.column(inputs, F.lit(i)) for i in range(arch.num_samples)]))

    search = {k: v for k, v in options.items() if k in optimize.SEARCH[args.optimizer]}
    best, scores = optimize.OPTIMIZERS[args.optimizer](programs, train, validation, predict, config, **search)
    for r in scores.orderBy("program").collect():
        print(f"program {r.program}: {r.objective} over {r.n}", file=sys.stderr)
    programs[best].save(args.output)


def main(argv: list[str] | None = None) -> int:
    from segloom.util import session

    args = parser().parse_args(argv)
    conf = {"spark__ui__showConsoleProgress": str(args.progress).lower()}
    if args.api_key:
        # before the session starts: workers read it from their environment; it isn't shown
        os.environ["SEGLOOM_API_KEY"] = args.api_key
        conf |= {"spark__executorEnv__SEGLOOM_API_KEY": args.api_key, "spark__redaction__regex": "(?i)secret|password|token|access[.]?key|api[._]?key"}
    spark = session(**conf)
    spark.sparkContext.setLogLevel("ERROR")
    # data alone goes to standard output; what libraries print doesn't mix with it
    out = sys.stdout
    with contextlib.redirect_stdout(sys.stderr):
        {"predict-da": predict_da, "train-da": train_da}[args.command](args, spark, out)
    out.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())

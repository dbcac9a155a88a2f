"""Queries of what surrounds scoring: files, programs, guards, failures, endpoint, options."""

from __future__ import annotations

import io
import json
import os
import tempfile
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.functions import aggregates, metrics
from segloom.operators import pairs, sampling, validate
from segloom.plans.queries import read, scratch, segments
from segloom.schema import INPUT_COLS, LABEL_COLS, PAIR_INPUT_COLS, PAIR_LABEL_COLS
from segloom.scoring.architectures import architecture
from segloom.scoring.base import ScorerConfig, ScoreResult, retried
from segloom.scoring.http import HttpScorer
from segloom.scoring.offline import HashScorer, hashed
from segloom.scoring.predict import score_segments
from segloom.sources.jsonl import load_examples, parse_lines, read_examples, read_lines, spool_stdin
from segloom.sources.sinks import write_ordered, write_unordered
from segloom.training import optimize
from segloom.training.program import Program

# files


def scan_compressed(spark, folder):
    """Segments written in completion order as gzip and bzip2, and read again."""
    rows = read(spark, folder, "segments").select(F.col("seg_id").alias("id"), *INPUT_COLS)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", *INPUT_COLS)])
    out = None
    for codec in ("gzip", "bzip2"):
        path = scratch(spark, codec)
        write_unordered(rows, path, codec=codec)
        back = parse_lines(read_lines(spark, path), schema=schema).select(F.lit(codec).alias("codec"), F.col("id").cast("bigint").alias("seg_id"), *INPUT_COLS)
        out = back if out is None else out.unionByName(back)
    return out


def sink_order(spark, folder):
    """Of an ordered sink: lines, lines that aren't after the line before in their file, and files
    that begin before the file before ends."""
    path = scratch(spark, "ordered")
    write_ordered(read(spark, folder, "segments").select("seg_id", F.col("seg_id").alias("id")), path, ["seg_id"])
    schema = T.StructType([T.StructField("id", T.StringType())])
    lines = parse_lines(read_lines(spark, path), schema=schema).select("file", "block", "ordinal", F.col("id").cast("bigint").alias("id"))
    # a file is what one task wrote
    before = F.lag("id").over(Window.partitionBy("file").orderBy("block", "ordinal"))
    files = lines.withColumn("late", (before > F.col("id")).cast("bigint")).groupBy("file").agg(F.count("*").alias("n"), F.coalesce(F.sum("late"), F.lit(0)).alias("late"), F.min("id").alias("a"), F.max("id").alias("b"))
    over = Window.orderBy("file")  # one row for each file
    files = files.withColumn("overlaps", (F.lag("b").over(over) > F.col("a")).cast("bigint"))
    return files.agg(F.sum("n").alias("n_lines"), F.sum("late").alias("n_late"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("n_overlaps"))


def scan_stdin(spark, folder):
    """The fixed table of languages as lines on standard input."""
    rows = read(spark, folder, "lang_names").collect()  # 15 rows
    lines = "".join(json.dumps({"src_lang": r.lang_code, "tgt_lang": r.alpha3, "src": r.lang_name, "tgt": None}) + "\n" for r in rows)
    path = spool_stdin(spark, io.BytesIO(lines.encode()))
    return parse_lines(read_lines(spark, path)).select("kind", "src_lang", "tgt_lang", "src", "tgt")


def rejected_lines(spark, folder):
    """Lines of the raw table that are no examples, by reason."""
    path = scratch(spark, "raw")
    write_unordered(read(spark, folder, "da_lines").where("raw is not null").select(F.col("raw").alias("value")), path, "value")
    _, bad = read_examples(spark, path)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


# programs


def _saved(program: Program, name: str | None = None) -> Program:
    with tempfile.TemporaryDirectory() as folder:  # a program is a small file of the driver
        path = os.path.join(folder, "program.json")
        program.save(path)
        return Program.load(path, name)


def program_state(spark, folder):
    """What is left of programs that were saved and loaded, one row for each setting."""
    rows = []
    for name in ("DA", "MR7", "MR7MEAN", "MR7RRWA"):
        program = Program.new(name)
        program.demos = [{"src": "ä"}]
        program.config |= {"num_samples": 4} if program.config else {}
        state = _saved(program).state()
        rows += [(name, key, json.dumps(state[key], ensure_ascii=False, sort_keys=True)) for key in ("architecture", "config", "demos", "input_fields")]
    return spark.createDataFrame(rows, "program string, setting string, value string")


def score_configured(spark, folder):
    """A loaded program's config takes the place of the architecture's: three samples, mean."""
    program = Program.new("MR7RRWA")
    program.config |= {"num_samples": 3, "method": "mean"}
    return score_segments(segments(spark, folder), "MR7RRWA", HashScorer(), config=_saved(program).config).select("seg_id", "score")


# failures


class Flaky:
    """The hash scorer behind the Python boundary; some rows fail, some time out at first."""

    def score_batch(self, prompts, sample):
        if len(prompts) > 1 and any(self.number(p) % 10 == 0 for p in prompts):
            raise RuntimeError("one bad row in a batch")
        return [self.one(p, sample) for p in prompts]

    def number(self, prompt) -> int:
        return hashed("fail", prompt["src"], prompt["tgt"])

    def one(self, prompt, sample) -> ScoreResult:
        number, calls = self.number(prompt), []

        def call():
            calls.append(1)
            if number % 10 == 0:
                raise ValueError("bad row")
            if number % 10 == 1 and len(calls) < 3 or number % 10 == 2:
                raise TimeoutError("late")
            return HashScorer().score_batch([prompt], sample)[0]

        return retried(call, sleep=lambda seconds: None)


def score_failures(spark, folder):
    """Failed rows score 0 and keep their message; late ones are asked again, five times at most."""
    out = score_segments(segments(spark, folder), "DA", Flaky())
    return out.select("seg_id", "score", F.substring_index("error", ":", 1).alias("error"))


def score_failed_samples(spark, folder):
    """Failed samples count as 0 in the aggregate."""

    class Third(Flaky):
        def score_batch(self, prompts, sample):
            if sample % 3 == 0:
                return [ScoreResult(0, error="failed") for _ in prompts]
            return HashScorer().score_batch(prompts, sample)

    return score_segments(segments(spark, folder), "MR7MEAN", Third()).select("seg_id", "score")


class Remembered(HashScorer):
    """Has no expression, so its answers are kept; `silent` fails on whatever it is asked."""

    column = property()

    def __init__(self, silent: bool = False):
        super().__init__()
        self.silent = silent

    def fingerprint(self) -> str:
        return "remembered"

    def score_batch(self, prompts, sample=0):
        if self.silent:
            raise RuntimeError("asked again")
        return super().score_batch(prompts, sample)


def score_cached(spark, folder):
    """The second of two runs with one folder of answers asks for nothing."""
    rows, cache = segments(spark, folder), scratch(spark, "answers")
    score_segments(rows, "DA", Remembered(), cache=cache)
    return score_segments(rows, "DA", Remembered(silent=True), cache=cache).select("seg_id", "score", "error")


# endpoint


def _endpoint():
    """A chat endpoint on the driver that answers with the hash score of the translation asked for."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        wbufsize = 1 << 16  # head and body of an answer in one packet

        def do_POST(self):
            with lock:
                server.now += 1
                server.most = max(server.most, server.now)
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            prompt = json.loads(text[text.rindex("Translation:") + len("Translation:") :])
            score = HashScorer().score_batch([prompt], 0)[0].score
            answer = json.dumps({"choices": [{"message": {"content": json.dumps({"score": score})}}]}).encode()
            with lock:
                server.now -= 1
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    lock = threading.Lock()
    server = ThreadingHTTPServer(("0.0.0.0", 0), Handler)
    server.daemon_threads = True
    server.now = server.most = 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def score_endpoint(spark, folder):
    """Segments scored over HTTP, by kept connections, with at most six requests at a time."""
    server = _endpoint()
    try:
        host = spark.conf.get("spark.driver.host", "localhost")
        config = ScorerConfig("hash", f"http://{host}:{server.server_port}/v1", max_concurrent=6)
        # answers are written before the frame is returned
        out = score_segments(segments(spark, folder), "DA", HttpScorer(architecture("DA").signature, config))
        most = server.most
    finally:
        server.shutdown()
        server.server_close()
    return out.select("seg_id", "score", "error", F.lit(most <= 6).alias("within_limit"))


# guards and options


def _message(call: Callable) -> str:
    try:
        call()
    except (ValueError, TypeError) as e:
        return str(e)
    except Exception as e:  # noqa: BLE001  of a Spark task: the line with the text
        return next((line for line in str(e).splitlines() if "Invalid score" in line), type(e).__name__)
    return "no error"


def guards(spark, folder):
    """The message of each guard on a wrong argument or file."""
    from segloom.cli import json_option

    rows = segments(spark, folder)
    path = scratch(spark, "bad")
    spark.createDataFrame([('{"src_lang":"en","tgt_lang":"de","src":"x","tgt":"y"}',)], "value string").write.text(path)
    wrong = scratch(spark, "wrong")
    spark.createDataFrame([('{"src_lang":"en","tgt_lang":"de","src":"x","tgt":"y","score":"not-a-number"}',)], "value string").write.text(wrong)

    def option():
        import argparse

        try:
            json_option("{bad")
        except argparse.ArgumentTypeError as e:
            raise ValueError(str(e).partition(":")[0]) from e

    found = {
        "k of pairs": lambda: pairs.k_pairs(rows, 0),
        "limit": lambda: sampling.shuffled(rows, "seg_id", limit=-1),
        "aggregation": lambda: aggregates.aggregate_scores("median", F.col("score")),
        "architecture": lambda: architecture("ESA"),
        "objective": lambda: metrics.metric_for("RMSE"),
        "training objective": lambda: optimize.load_sets(rows, None, optimize.TrainingConfig("RMSE")),
        "required fields": lambda: validate.require_fields(rows.drop("score", "src")),
        "file without scores": lambda: load_examples(spark, path),
        "file with a wrong score": lambda: load_examples(spark, wrong),
        "samples": lambda: architecture("MR7MEAN").configured({"num_samples": 0}),
        "option": option,
    }
    return spark.createDataFrame([(name, _message(call)) for name, call in found.items()], "guard string, message string")


def input_roles(spark, folder):
    """Columns of examples and pairs by their role."""
    roles = {"example input": INPUT_COLS, "example label": LABEL_COLS, "pair input": PAIR_INPUT_COLS, "pair label": PAIR_LABEL_COLS}
    return spark.createDataFrame([(role, i, c) for role, cols in roles.items() for i, c in enumerate(cols)], "role string, place int, name string")


def search_settings(spark, folder):
    """Options of the searches from two dictionaries, and those they don't have."""
    rows = []
    for name, params, compile_params in (("MIPROv2", {"num_candidates": 6, "max_demos": 2}, {"num_trials": 9, "seed": 7, "x": 1}), ("SIMBA", {"bsize": 32, "max_steps": 3}, {"seed": 5})):
        options = optimize.search_options(name, params, compile_params)
        rows += [(name, key, str(value)) for key, value in options.items() if key != "unknown"] + [(name, "unknown", x) for x in options["unknown"]]
    return spark.createDataFrame(rows, "search string, setting string, value string")


def training_sets(spark, folder):
    """The first examples and pairs of a training set, in seeded order."""
    rows = segments(spark, folder)
    single, _ = optimize.load_sets(rows, None, optimize.TrainingConfig("tRMSE", train_max_examples=100))
    _, pair = optimize.load_sets(rows, rows, optimize.TrainingConfig("PA", validation_max_examples=60, pairs_per_source=3))
    return single.select(F.lit("example").alias("kind"), F.col("seg_id").alias("id1"), F.col("seg_id").alias("id2")).unionByName(pair.select(F.lit("pair").alias("kind"), "id1", "id2"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        scan_compressed, sink_order, scan_stdin, rejected_lines, program_state, score_configured, score_failures, score_failed_samples,
        score_cached, score_endpoint, guards, input_roles, search_settings, training_sets,
    ]
    return {f.__name__: f for f in plain}

"""JSON lines in: typed columns next to the raw line, and rejects instead of a failed run."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.functions.scalar import parse_score
from segloom.schema import INPUT_COLS, LINE
from segloom.util import shared_dir


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (.gz, .bz2 and .zst by their ending): raw, file, ordinal.

    Ordinals rise in the order of the lines of a file; they have gaps. Files are listed by name
    and split by position, so the order of partitions is the order of the input.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.select("raw", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ordinal"))


def parse_lines(lines: DataFrame, raw_col: str = "raw", schema: T.StructType = LINE) -> DataFrame:
    """Adds the typed columns and `kind` of each line: ok, blank, broken or no object.

    All values are read as text first, so `"007"` stays what it is and a date is no timestamp;
    the last of repeated keys counts; unknown keys stay in the raw line. `score` becomes a
    double where it is a finite number (quoted or not), else null.
    """
    line = F.trim(F.regexp_replace(F.col(raw_col), r"^\s+|\s+$", ""))
    typed = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(line, typed, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    out = lines.withColumn("_line", line).withColumn("_json", parsed)
    whole = F.col("_line").startswith("{") & F.col("_line").endswith("}") & F.col("_json._bad").isNull() & F.get_json_object("_line", "$").isNotNull()
    kind = F.when(F.col(raw_col).isNull() | (F.col("_line") == ""), "blank").when(~F.col("_line").startswith("{"), "no object").when(whole, "ok").otherwise("broken")
    out = out.withColumn("kind", kind)
    fields = [F.when(F.col("kind") == "ok", F.col(f"_json.{f.name}")).alias(f.name) for f in schema.fields if f.name != "score"]
    score = [F.when(F.col("kind") == "ok", parse_score(F.col("_json.score"))).alias("score")] if "score" in schema.names else []
    taken = {f.name for f in schema.fields} | {"_line", "_json", "kind"}
    return out.select(*[c for c in lines.columns if c not in taken], "kind", *fields, *score)


def read_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(examples, rejects) of a labelled JSONL file; rejects keep their raw line and a reason."""
    parsed = parse_lines(read_lines(spark, path))
    usable = (F.col("kind") == "ok") & F.col("score").isNotNull()
    for c in INPUT_COLS:
        usable &= F.col(c).isNotNull()
    reason = F.when(F.col("kind") != "ok", F.col("kind")).when(F.col("score").isNull(), "invalid score").otherwise("missing field")
    return parsed.where(usable).select("ordinal", *INPUT_COLS, "score"), parsed.where(~usable & (F.col("kind") != "blank")).select("ordinal", "raw", reason.alias("reason"))


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a labelled file that must be right as a whole: ordinal and five fields.

    Fails before anything else runs if no line has a required field, a line lacks one, or a
    score isn't a finite number. Blank lines and lines that are no object are left out.
    """
    parsed = parse_lines(read_lines(spark, path)).where("kind = 'ok'").withColumn("given", F.get_json_object("raw", "$.score"))
    have = parsed.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in (*INPUT_COLS, "given")]).first()
    name = lambda c: "score" if c == "given" else c
    for lacking in (lambda c: have[c] == 0, lambda c: have[c] < have.n):
        if have.n and (missing := sorted(name(c) for c in (*INPUT_COLS, "given") if lacking(c))):
            raise ValueError(f"Missing required fields: {', '.join(missing)}")
    if wrong := parsed.where("score is null").select("given").first():
        raise ValueError(f"Invalid score value: {wrong.given!r}")
    return parsed.select("ordinal", *INPUT_COLS, "score")


def spool_stdin(spark: SparkSession, stream=None) -> str:
    """Copies standard input to a file in the shared folder and returns its path."""
    stream = stream or sys.stdin.buffer
    folder = shared_dir(spark).removeprefix("file://")
    if "://" in folder:
        raise ValueError("standard input needs a shared folder that is mounted on the driver")
    path = os.path.join(folder, f"stdin-{uuid.uuid4().hex}.jsonl")
    os.makedirs(folder, exist_ok=True)
    with open(path, "wb") as f:
        while chunk := stream.read(1 << 20):
            f.write(chunk)
    return path

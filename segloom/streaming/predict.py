"""Stateless scoring of JSON lines as they arrive: the batch pipeline on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.scoring.predict import predict
from segloom.sources.jsonl import parse_lines
from segloom.sources.sinks import json_line


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, arch_name: str, scorer, max_segment_tokens: int | None = None, once: bool = True, rejects: str | None = None):
    """Scores new lines of the text files in `source` into JSON lines in `sink`.

    Each micro-batch goes through the same plan as a batch run and is written to a folder named
    by its number, which a repeated batch overwrites; so every line is scored into the result
    exactly once. Lines without a record go to `rejects`. `once` stops when all is read.
    """

    def handle(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch.withColumnRenamed("value", "raw"))
        good = parsed.where("kind = 'ok' and src is not null and tgt is not null")
        scored = predict(good.drop("raw", "kind"), arch_name, scorer, max_segment_tokens)
        scored.select(json_line("src_lang", "tgt_lang", "src", "tgt", "score", "error").alias("value")).write.mode("overwrite").text(f"{sink}/batch={number}")
        if rejects:
            bad = parsed.where(~F.coalesce((F.col("kind") == "ok") & F.col("src").isNotNull() & F.col("tgt").isNotNull(), F.lit(False)) & (F.col("kind") != "blank"))
            bad.select(F.col("raw").alias("value")).write.mode("overwrite").text(f"{rejects}/batch={number}")

    stream = spark.readStream.text(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segloom.llm import collapse, corpus_encode, grouped_splits, langid, mojibake, overlap, packing, token_budget, truncation_model, visual_form


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shares(spark, folder) -> list[tuple[str, float]]:
    """The three rows of the fixed table."""
    return [(r.split_name, r.split_share) for r in _read(spark, folder, "split_shares").orderBy("split_share", ascending=False).collect()]


def _capacities(spark, folder) -> list[tuple[str, int]]:
    """The three rows of the fixed table."""
    return [(r.size_name, r.capacity_tokens) for r in _read(spark, folder, "context_sizes").orderBy("capacity_tokens").collect()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    read = _read
    return {
        "p1_found": lambda s, d: grouped_splits.related_rows(read(s, d, "segments"), names=read(s, d, "lang_names")),
        "p1_splits": lambda s, d: grouped_splits.assign_splits(read(s, d, "segments"), _shares(s, d), names=read(s, d, "lang_names")),
        "p1_report": lambda s, d: grouped_splits.split_report(read(s, d, "segments"), _shares(s, d), names=read(s, d, "lang_names")),
        "p1_check": lambda s, d: grouped_splits.split_check(read(s, d, "segments"), _shares(s, d), names=read(s, d, "lang_names")),
        "p2_found": lambda s, d: truncation_model.cut_fields(read(s, d, "segments")),
        "p2_report": lambda s, d: truncation_model.cut_report(read(s, d, "segments")),
        "p2_totals": lambda s, d: truncation_model.cut_report(read(s, d, "segments")).select("origin", "field_name", "n_texts"),
        "p3_budget": lambda s, d: token_budget.token_budget(read(s, d, "segments"), names=read(s, d, "lang_names")),
        "p3_texts": lambda s, d: token_budget.text_tokens(read(s, d, "segments")),
        "p3_slices": lambda s, d: token_budget.token_budget(read(s, d, "segments"), names=read(s, d, "lang_names")).drop("n_tokens"),
        "p4_found": lambda s, d: mojibake.garbled_fields(read(s, d, "segments")),
        "p4_restored": lambda s, d: mojibake.restored_fields(read(s, d, "segments")),
        "p5_found": lambda s, d: langid.wrong_labels(read(s, d, "segments"), names=read(s, d, "lang_names")),
        "p5_stretches": lambda s, d: langid.text_languages(read(s, d, "segments"), names=read(s, d, "lang_names")),
        "p6_found": lambda s, d: collapse.copies(read(s, d, "da_lines")),
        "p6_records": lambda s, d: collapse.distinct_records(read(s, d, "da_lines")),
        "p7_found": lambda s, d: overlap.split_overlaps(read(s, d, "split_examples")),
        "p7_rows": lambda s, d: overlap.overlap_rows(read(s, d, "split_examples")),
        "p7_report": lambda s, d: overlap.overlap_report(read(s, d, "split_examples")),
        "p7_exact": lambda s, d: overlap.overlap_rows(read(s, d, "split_examples")).where("exact").select("ex_id"),
        "p8_ids": lambda s, d: corpus_encode.encode_corpus(read(s, d, "documents")),
        "p9_containers": lambda s, d: packing.fill_containers(read(s, d, "documents"), _capacities(s, d)),
        "p9_fill": lambda s, d: packing.fill_report(read(s, d, "documents"), _capacities(s, d)),
        "p9_check": lambda s, d: packing.fill_check(read(s, d, "documents"), _capacities(s, d)),
        "p10_found": lambda s, d: visual_form.look_alike_pairs(read(s, d, "documents")),
        "p10_classes": lambda s, d: visual_form.look_alike_classes(read(s, d, "documents")),
        "p10_texts": lambda s, d: visual_form.consistent_texts(read(s, d, "documents")),
        "p10_report": lambda s, d: visual_form.spelling_report(read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    from segloom.llm.sql import SQL

    return dict(SQL)

"""Records that are equal but for formatting, collapsed with their numbers of copies.

Byte-identical lines are collapsed first, so parsing and canonicalising is done once for each
distinct line; the canonical texts of those are grouped again, adding up the counts.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.util import digest, table

_NUMBER = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*\Z", re.ASCII)


@functools.lru_cache(maxsize=1 << 16)
def _ignored(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind[0] in "PZ" or kind in ("Cc", "Cf")


class _Fold(dict):
    """Translation table that drops white space and punctuation, made on use; signs like `<` and
    `+` say something and stay."""

    def __missing__(self, code: int):
        self[code] = out = None if _ignored(chr(code)) else code
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text without letter case, white space and punctuation."""
    return unicodedata.normalize("NFC", text).casefold().translate(_FOLD)


def number(value) -> float | None:
    """A finite score from a JSON number or a quoted one; true and false are no numbers."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        value = str(value) if isinstance(value, int) and abs(value) > 2**1000 else value
    if isinstance(value, str):
        if not _NUMBER.match(value):
            return None
    elif not isinstance(value, (int, float)):
        return None
    out = float(value)
    return out if math.isfinite(out) else None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True)


def parse(line: str | None):
    """(src_lang, tgt_lang, src, tgt, score) of a line, or None if it holds no record.

    A record is a JSON object with src and tgt that aren't null and a finite score. Of a
    repeated key the last one counts. A byte order mark before the object is ignored.
    """
    if line is None:
        return None
    try:
        value = json.loads(line.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or value.get("src") is None or value.get("tgt") is None:
        return None
    score = number(value.get("score"))
    if score is None:
        return None
    return (*(_text(value.get(k)) for k in ("src_lang", "tgt_lang", "src", "tgt")), score)


def canonical(record) -> str:
    """Full canonical text of a record; a missing language differs from any other."""
    *texts, score = record
    parts = ["\x02" if t is None else "\x01" + fold(t) for t in texts]
    return "\x1f".join([*parts, repr(score + 0.0)]).encode("utf-8", "backslashreplace").decode()


def _clean(text: str | None) -> str | None:
    return None if text is None else text.encode("utf-8", "replace").decode()


def _canonicalise(batches):
    names = ["canon", "src_lang", "tgt_lang", "src", "tgt", "score"]
    for batch in batches:
        out = [[] for _ in names]
        keep = []
        for i, line in enumerate(batch.column(0).to_pylist()):
            if (record := parse(line)) is not None:
                keep.append(i)
                for column, v in zip(out, (canonical(record), *map(_clean, record[:4]), record[4])):
                    column.append(v)
        index = pa.array(keep, pa.int64())
        kinds = [pa.string()] * 5 + [pa.float64()]
        columns = [batch.column(k).take(index) for k in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, out, kinds)], ["line", "first_id", "n", *names])


def _survivors(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """Distinct lines that hold records: line (key), first_id, n and the record."""
    lines = df.where(F.col(raw_col).isNotNull()).groupBy(F.col(raw_col).alias("raw")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
    keyed = lines.select("raw", digest(F.col("raw")).alias("line"), "first_id", "n")
    kind = keyed.schema["first_id"].dataType.simpleString()
    return keyed.mapInArrow(_canonicalise, f"line binary, first_id {kind}, n bigint, canon string, src_lang string, tgt_lang string, src string, tgt string, score double")


def distinct_records(df: DataFrame, id_col: str = "line_id", raw_col: str = "raw") -> DataFrame:
    """Each distinct record once: first_id, n_copies and the record as its first line has it.

    Lines that hold no record (null, blank, broken, no object, null src or tgt, no finite
    score) are left out. Languages are compared as written, but for case and punctuation.
    Both groupings combine before their shuffles, so a line or record that makes up a third of
    all rows is one row for each task.
    """
    rows = _survivors(df, id_col, raw_col)
    record = F.struct("first_id", "src_lang", "tgt_lang", "src", "tgt", "score")
    best = rows.groupBy("canon").agg(F.min(record).alias("r"), F.sum("n").alias("n_copies"))
    return best.select("r.first_id", "n_copies", "r.src_lang", "r.tgt_lang", "r.src", "r.tgt", "r.score")


def copies(df: DataFrame, id_col: str = "line_id", raw_col: str = "raw") -> DataFrame:
    """For each set of equal records a row for each line but the first: (first_id, copy_id)."""
    rows = table(_survivors(df, id_col, raw_col).select("line", "canon", "first_id"), "survivors")
    groups = rows.groupBy("canon").agg(F.min("first_id").alias("first_id"))
    firsts = rows.select("line", "canon").join(groups, "canon").select("line", "first_id")
    lines = df.where(F.col(raw_col).isNotNull()).select(F.col(id_col).alias("copy_id"), digest(F.col(raw_col)).alias("line"))
    return lines.join(firsts, "line").where("copy_id != first_id").select("first_id", "copy_id")

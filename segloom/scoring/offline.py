"""Deterministic scorers without a model: for tests, dry runs and comparisons in SQL."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from segloom.functions.scalar import hash_fraction
from segloom.schema import CRITERIA
from segloom.scoring.base import ScoreResult


def hashed(*parts: Any) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


class LengthRatio:
    """floor(100 * shorter / longer text), 0 if both are empty or one is null."""

    def score_batch(self, prompts, sample=0):
        out = []
        for p in prompts:
            a, b = len(p["src"] or ""), len(p["tgt"] or "")
            out.append(ScoreResult(int(100.0 * min(a, b) / max(a, b)) if max(a, b) else 0))
        return out

    def column(self, inputs: dict[str, Column], sample: Column | None = None) -> Column:
        a, b = (F.coalesce(F.length(inputs[c]), F.lit(0)) for c in ("src", "tgt"))
        return F.when(F.greatest(a, b) == 0, F.lit(0)).otherwise(F.floor(F.lit(100.0) * F.least(a, b) / F.greatest(a, b))).cast("int")


class HashScorer:
    """A score from 0 to 100 by the hash of languages, texts, terms (if there are any) and the
    sample's number."""

    def __init__(self, salt: str = "s"):
        self.salt = salt

    def score_batch(self, prompts, sample=0):
        out = []
        for p in prompts:
            key = [p[c] or "" for c in ("src_lang", "tgt_lang", "src", "tgt")]
            if "terminology" in p:
                key.append(",".join(t["src"] or "" for t in (json.loads(p["terminology"]) if isinstance(p["terminology"], str) else p["terminology"]) or ()))
            subs = {c: hashed(self.salt, c, *key) % 11 for c in CRITERIA}
            out.append(ScoreResult(hashed(self.salt, sample, *key) % 101, subs))
        return out

    def column(self, inputs: dict[str, Column], sample: Column | None = None) -> Column:
        key = [F.coalesce(inputs[c], F.lit("")) for c in ("src_lang", "tgt_lang", "src", "tgt")]
        if "terminology" in inputs:
            key.append(F.coalesce(F.array_join(F.transform(inputs["terminology"], lambda t: F.coalesce(t["src"], F.lit(""))), ","), F.lit("")))
        number = F.lit("0") if sample is None else sample.cast("string")
        return (hash_fraction(F.lit(self.salt), number, *key) % 101).cast("int")

    def subscore(self, criterion: str, inputs: dict[str, Column]) -> Column:
        key = [F.coalesce(inputs[c], F.lit("")) for c in ("src_lang", "tgt_lang", "src", "tgt")]
        return (hash_fraction(F.lit(self.salt), F.lit(criterion), *key) % 11).cast("int")

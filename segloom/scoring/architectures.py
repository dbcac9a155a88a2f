"""Scoring architectures: what is asked, how often, and how samples become one score."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from segloom.functions.aggregates import METHODS
from segloom.schema import CRITERIA, INPUT_COLS


@dataclass(frozen=True)
class Signature:
    inputs: list[str]
    outputs: dict[str, str]
    instruction: str


@dataclass(frozen=True)
class Architecture:
    name: str
    signature: Signature
    num_samples: int = 1
    method: str | None = None
    sampling_temperature: float = 0.5
    subscores: list[str] = field(default_factory=list)

    def config(self) -> dict:
        """The settings that a saved program replaces; none for an architecture of one sample."""
        return {"num_samples": self.num_samples, "method": self.method, "sampling_temperature": self.sampling_temperature} if self.method else {}

    def configured(self, config: dict[str, Any] | None) -> "Architecture":
        """With the settings of a program; an architecture of one sample has none to replace."""
        if not self.method or not config:
            return self
        out = replace(self, **{k: config[k] for k in self.config() if k in config})
        if out.num_samples < 1:
            raise ValueError("num_samples must be >= 1")
        if out.method not in METHODS:
            raise ValueError(f"Unknown aggregation method: {out.method}")
        return out


OVERALL = {"score": "overall quality from 0 (useless) to 100 (perfect)"}
#: What each criterion asks for, in our own words.
ASKS = {
    "accuracy": "0-10, is the meaning kept whole, with nothing added or lost",
    "terminology": "0-10, are terms right for the field and used alike throughout",
    "fluency": "0-10, does it read like text written in the language",
    "style": "0-10, do register and tone suit the readers",
    "locale": "0-10, do numbers, units, dates and signs follow local custom",
    "technical": "0-10, are tags, placeholders and layout intact",
    "cultural": "0-10, do idioms and references work in the target culture",
}
DIRECT = Signature(list(INPUT_COLS), OVERALL, "Rate how good the translation of the source is.")
TERMS = Signature([*INPUT_COLS, "terminology"], OVERALL, "Rate how good the translation is; it should use the terms given.")
SEVEN = Signature(list(INPUT_COLS), {c: ASKS[c] for c in CRITERIA} | OVERALL, "Rate the translation by each criterion, then as a whole.")

ARCHITECTURES = {
    "DA": Architecture("DA", DIRECT),
    "DATERM": Architecture("DATERM", TERMS),
    "MR7": Architecture("MR7", SEVEN, subscores=CRITERIA),
    "MR8": Architecture("MR8", SEVEN, subscores=CRITERIA),
    "MR7MEAN": Architecture("MR7MEAN", SEVEN, 10, "mean", subscores=CRITERIA),
    "MR7RRWA": Architecture("MR7RRWA", SEVEN, 10, "RRWA", subscores=CRITERIA),
}


def architecture(name: str) -> Architecture:
    if name not in ARCHITECTURES:
        raise ValueError(f"Unknown architecture: {name}. Available architectures: {', '.join(sorted(ARCHITECTURES))}")
    return ARCHITECTURES[name]

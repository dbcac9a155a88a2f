"""A scoring program: what prompt search changes, saved as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from segloom.schema import INPUT_COLS
from segloom.scoring.architectures import architecture


@dataclass
class Program:
    architecture: str
    instruction: str | None = None
    demos: list[dict[str, Any]] = field(default_factory=list)
    config: dict[str, Any] = field(default_factory=dict)
    input_fields: list[str] = field(default_factory=lambda: sorted(INPUT_COLS))
    output_fields: list[str] = field(default_factory=lambda: ["score"])
    #: Numbers of the instruction and the demonstrations in a search; not saved.
    choice: tuple[int, int] = (0, 0)

    @classmethod
    def new(cls, name: str) -> "Program":
        arch = architecture(name)
        return cls(name, arch.signature.instruction, config=arch.config(), input_fields=sorted(arch.signature.inputs), output_fields=sorted(arch.signature.outputs))

    def state(self) -> dict[str, Any]:
        return {"architecture": self.architecture, "instruction": self.instruction, "demos": self.demos, "config": self.config, "input_fields": sorted(self.input_fields), "output_fields": sorted(self.output_fields)}

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.state(), f, ensure_ascii=False, indent=2, sort_keys=True)

    @classmethod
    def load(cls, path: str, name: str | None = None) -> "Program":
        """A saved program; its config replaces that of the architecture."""
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
        base = cls.new(name or state["architecture"]).state()
        return cls(**(base | {k: v for k, v in state.items() if k in base} | {"architecture": name or state["architecture"]}))

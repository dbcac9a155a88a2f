"""What a scorer is, and how failures become scores."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column


@dataclass(frozen=True)
class ScoreResult:
    score: int | None
    subscores: dict[str, int] | None = None
    error: str | None = None


@dataclass(frozen=True)
class ScorerConfig:
    """Connection and sampling settings. The key is read from the environment by the worker.

    max_concurrent is the number of requests of the whole job; `tasks` is the number of tasks
    that may run at a time, among which it is divided.
    """

    model: str = ""
    api_base: str | None = None
    key_variables: tuple[str, ...] = ("SEGLOOM_API_KEY", "OPENAI_API_KEY")
    max_tokens: int = 2048
    max_concurrent: int = 100
    tasks: int = 1
    timeout: float = 6000.0
    verify_tls: bool = True
    sampling: dict[str, Any] = field(default_factory=dict)

    @property
    def per_task(self) -> int:
        return max(1, self.max_concurrent // max(1, self.tasks))

    def request_options(self) -> dict[str, Any]:
        """max_tokens and the sampling settings; the latter win."""
        return {"max_tokens": self.max_tokens} | dict(self.sampling)


class Scorer(Protocol):
    """Scores prompts in batches. A scorer that can be written as an expression has `column`
    as well, and then never leaves the JVM."""

    def score_batch(self, prompts: list[dict[str, Any]], sample: int) -> list[ScoreResult]: ...


class ColumnScorer(Protocol):
    def column(self, inputs: dict[str, Column], sample: Column) -> Column: ...


def retried(call: Callable[[], ScoreResult], attempts: int = 5, least: float = 1.0, most: float = 10.0, jitter: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> ScoreResult:
    """Repeats on timeouts with growing waits; any other error, or the last one, scores 0.

    The error stays next to the 0, so a failure can be told from a real 0.
    """
    for attempt in range(attempts):
        try:
            return call()
        except TimeoutError as e:
            if attempt + 1 == attempts:
                return ScoreResult(0, error=f"timeout: {e}")
            sleep(min(most, max(least, 2.0**attempt)) + random.random() * jitter)
        except Exception as e:  # noqa: BLE001
            return ScoreResult(0, error=f"{type(e).__name__}: {e}")
    return ScoreResult(0, error="no attempt")

"""Scorer for a chat endpoint that speaks the common completions protocol.

The first sample of an answer is asked for directly; further ones ask for the reasoning first,
at the sampling temperature, each with a seed of its own.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import queue
import re
import ssl
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any
from urllib.parse import urlsplit

from segloom.scoring.base import ScoreResult, ScorerConfig, retried

NUMBER = re.compile(r"-?\d+")


def prompt_text(signature, program: dict[str, Any] | None, prompt: dict[str, Any], reasoning: bool = False) -> str:
    """The request text of one translation: instruction, output format, examples, inputs."""
    program = program or {}
    lines = [program.get("instruction") or signature.instruction, ""]
    if reasoning:
        lines.append("Think step by step: write your reasoning into a text field `reasoning` before the scores.")
    lines.append("Answer with one JSON object with these integer fields:")
    lines += [f"- {name}: {text}" for name, text in signature.outputs.items()]
    for demo in program.get("demos", []):
        lines += ["", "Example:", json.dumps(demo, ensure_ascii=False)]
    lines += ["", "Translation:", json.dumps({k: prompt.get(k) for k in signature.inputs}, ensure_ascii=False)]
    return "\n".join(lines)


def read_answer(signature, text: str) -> ScoreResult:
    """The scores in an answer; an answer without a score is an error."""
    start, end = text.find("{"), text.rfind("}")
    fields: dict[str, Any] = {}
    if 0 <= start < end:
        try:
            fields = json.loads(text[start : end + 1])
        except ValueError:
            fields = {}
    values = {k: int(m.group()) for k in signature.outputs if (m := NUMBER.search(str(fields.get(k, ""))))}
    if "score" not in values:
        raise ValueError("the answer has no score")
    return ScoreResult(values.pop("score"), values or None)


class Pool:
    """Open connections to one endpoint, shared by the threads of a worker."""

    def __init__(self, base: str, timeout: float, verify: bool):
        self.parts, self.timeout, self.verify = urlsplit(base), timeout, verify
        self.idle: queue.LifoQueue[http.client.HTTPConnection] = queue.LifoQueue()

    def _new(self) -> http.client.HTTPConnection:
        if self.parts.scheme == "https":
            context = ssl.create_default_context() if self.verify else ssl._create_unverified_context()
            return http.client.HTTPSConnection(self.parts.netloc, timeout=self.timeout, context=context)
        return http.client.HTTPConnection(self.parts.netloc, timeout=self.timeout)

    def post(self, path: str, body: bytes, headers: dict[str, str]) -> bytes:
        """The answer to a request; a kept connection that the server closed is replaced once."""
        try:
            connection, kept = self.idle.get_nowait(), True
        except queue.Empty:
            connection, kept = self._new(), False
        try:
            try:
                connection.request("POST", self.parts.path + path, body, headers)
                answer = connection.getresponse()
            except (http.client.RemoteDisconnected, ConnectionError):
                connection.close()
                if not kept:
                    raise
                connection = self._new()
                connection.request("POST", self.parts.path + path, body, headers)
                answer = connection.getresponse()
            text = answer.read()
        except BaseException:
            connection.close()
            raise
        if answer.will_close:
            connection.close()
        else:
            self.idle.put(connection)
        if answer.status >= 400:
            raise OSError(f"status {answer.status}: {text[:200]!r}")
        return text


_POOLS: dict[tuple, Pool] = {}
_LOCK = threading.Lock()


def pool_of(base: str, timeout: float, verify: bool) -> Pool:
    """The pool of this worker for an endpoint."""
    with _LOCK:
        return _POOLS.setdefault((base, timeout, verify), Pool(base, timeout, verify))


class HttpScorer:
    """`program` may hold an instruction, demos and a config with a sampling_temperature."""

    def __init__(self, signature, config: ScorerConfig, program: dict[str, Any] | None = None, temperature: float = 0.5):
        self.signature, self.config, self.program = signature, config, program
        self.temperature = ((program or {}).get("config") or {}).get("sampling_temperature", temperature)

    @property
    def max_concurrent(self) -> int:
        return self.config.max_concurrent

    def shared_by(self, tasks: int) -> "HttpScorer":
        """The scorer for one of so many tasks that run at a time."""
        return HttpScorer(self.signature, replace(self.config, tasks=tasks), self.program, self.temperature)

    def fingerprint(self) -> str:
        """What an answer depends on besides the prompt; equal for scorers that ask the same."""
        asks = [self.config.model, self.config.api_base, self.config.request_options(), self.program, self.temperature, self.signature.instruction, self.signature.outputs]
        return hashlib.md5(json.dumps(asks, sort_keys=True, default=str).encode()).hexdigest()

    def complete(self, text: str, sample: int = 0) -> str:
        """The endpoint's answer to a text, as it is."""
        options = self.config.request_options()
        if sample:
            options |= {"temperature": self.temperature, "seed": sample}
        body = {"model": self.config.model, "messages": [{"role": "user", "content": text}], **options}
        key = next((os.environ[v] for v in self.config.key_variables if os.environ.get(v)), "NIL")
        base = (self.config.api_base or "http://localhost:8000/v1").rstrip("/")
        pool = pool_of(base, self.config.timeout, self.config.verify_tls)
        reply = json.loads(pool.post("/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}))
        return reply["choices"][0]["message"]["content"]

    def _call(self, prompt: dict[str, Any], sample: int) -> ScoreResult:
        return read_answer(self.signature, self.complete(prompt_text(self.signature, self.program, prompt, sample > 0), sample))

    def score_batch(self, prompts, sample=0):
        """All prompts of a batch, at most per_task of them at a time."""
        if not prompts:
            return []
        with ThreadPoolExecutor(max(1, min(len(prompts), self.config.per_task))) as pool:
            return list(pool.map(lambda p: retried(lambda: self._call(p, sample)), prompts))

"""The model stage: one call per prompt through an ordered chain of models, with an event for each attempt.

A model is any picklable callable from a prompt and settings to text. Calls run
inside Arrow batches with a pool of threads per task. As tasks may be retried,
calls can repeat; write the stage's output to storage before using it twice.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.core.errors import InferenceRuntimeError
from textlode.core.jstext import PY_WS, strip



@dataclass(frozen=True)
class Answer:
    """A model's text with what it reports of its use of tokens."""

    text: str
    usage: Mapping[str, Any] | None = None


Generate = Callable[[str, Mapping[str, Any]], "str | Answer"]

# Status codes and words of errors that the next model may overcome.
RETRIABLE = frozenset((404, 408, 409, 425, 429, 500, 502, 503, 504))
RETRIABLE_WORDS = re.compile("deprecated|not found|temporar|unavailable|rate limit|overload", re.IGNORECASE)
RETRIABLE_SQL = "(?i)deprecated|not found|temporar|unavailable|rate limit|overload"
# The settings that a call may carry.
SETTINGS = ("temperature", "top_p", "top_k", "max_output_tokens", "frequency_penalty", "presence_penalty", "stop_sequences", "seed", "timeout", "max_retries", "headers", "provider_options")


class ModelError(Exception):
    """What a model raises; ``status`` is its HTTP status where it has one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Model:
    provider: str
    model_id: str
    generate: Generate


@dataclass(frozen=True)
class Chain:
    """A primary model and its fallbacks, with the settings of their calls."""

    models: Sequence[Model]
    settings: Mapping[str, Any] = field(default_factory=dict)
    debug: bool = False

    def __post_init__(self) -> None:
        if not self.models:
            raise ValueError("a chain needs a model")
        unknown = set(self.settings) - set(SETTINGS)
        if unknown:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")


def is_retriable(e: BaseException) -> bool:
    status = getattr(e, "status", None)
    if isinstance(status, int) and not isinstance(status, bool):
        return status in RETRIABLE
    return bool(RETRIABLE_WORDS.search(str(e)))


_KEY = re.compile(r"(api[_-]?key\s*[:=]\s*)([^\s,;]+)", re.IGNORECASE)
_BEARER = re.compile(r"(authorization\s*[:=]\s*bearer\s+)([^\s,;]+)", re.IGNORECASE)


def redacted(message: str) -> str:
    return _BEARER.sub(r"\1[REDACTED]", _KEY.sub(r"\1[REDACTED]", message))[:600]


def _preview(text: str, most: int = 160) -> str:
    flat = strip(re.sub(PY_WS + "+", " ", text))
    return flat if len(flat) <= most else flat[: most - 3] + "..."


def call(chain: Chain, prompt: str) -> tuple[str | None, list[dict[str, Any]], str | None]:
    """(output, an event per attempt, error) of one prompt; a failure that isn't retriable, or the last, ends the chain."""
    events = []
    for n, m in enumerate(chain.models):
        began = time.monotonic()
        error = answer = None
        try:
            answer = m.generate(prompt, chain.settings)
            answer = answer if isinstance(answer, Answer) else Answer(answer)
        except Exception as e:  # noqa: BLE001 - whatever a model raises is an outcome of its call
            error = e
        event = {
            "provider": m.provider,
            "model_id": m.model_id,
            "attempt": n + 1,
            "fallback_used": n > 0,
            "duration_ms": (time.monotonic() - began) * 1000,
            "success": error is None,
            "error_name": None if error is None else type(error).__name__,
            "error_message": None if error is None else redacted(str(error)),
            "usage_json": json.dumps(answer.usage, ensure_ascii=False, default=str) if answer and answer.usage is not None else None,
        }
        if chain.debug:
            event |= {"prompt_chars": len(prompt), "prompt_preview": _preview(prompt)}
            event |= {"output_chars": len(answer.text), "output_preview": _preview(answer.text)} if answer else {}
        events.append(event)
        if error is None:
            return answer.text, events, None
        if n + 1 == len(chain.models) or not is_retriable(error):
            return None, events, f"Model call failed for {m.provider}:{m.model_id}. {redacted(str(error))}"
    raise AssertionError


#: The fields of an event; lengths and previews are there in debug runs only.
EVENT_FIELDS = {
    "provider": "string", "model_id": "string", "attempt": "int", "fallback_used": "boolean", "duration_ms": "double", "success": "boolean", "error_name": "string",
    "error_message": "string", "usage_json": "string", "prompt_chars": "int", "output_chars": "int", "prompt_preview": "string", "output_preview": "string",
}
EVENT = "struct<" + ",".join(f"{k}:{v}" for k, v in EVENT_FIELDS.items()) + ">"
_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_EVENT = pa.struct([(k, _ARROW_TYPES[v]) for k, v in EVENT_FIELDS.items()])


def generate(df: DataFrame, chain: Chain, prompt: str = "prompt", workers: int = 10, fail_fast: bool = True, done: Callable[[int, int], None] | None = None, size: str | None = None) -> DataFrame:
    """``df`` without its prompt column, with ``output``, ``calls`` and ``call_error``.

    A null prompt isn't called. With ``fail_fast`` a prompt that no model answers
    fails the query, else its row has the error. ``done`` is told the prompts of
    each Arrow batch and the sum of the column ``size``, on the executors.
    """
    kept = [c for c in df.columns if c != prompt]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != prompt) + f", output string, calls array<{EVENT}>, call_error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for batch in batches:
                answers = list(pool.map(lambda p: (None, [], None) if p is None else call(chain, p), batch.column(len(kept)).to_pylist()))
                if done:
                    done(batch.num_rows, sum(x or 0 for x in batch.column(batch.schema.names.index(size)).to_pylist()) if size else 0)
                failed = next((e for _, _, e in answers if e), None)
                if failed and fail_fast:
                    raise InferenceRuntimeError(failed)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(kept)], pa.array([o for o, _, _ in answers], pa.string()), pa.array([c for _, c, _ in answers], pa.list_(_EVENT)), pa.array([e for _, _, e in answers], pa.string())],
                    names=[*kept, "output", "calls", "call_error"],
                )

    return df.select(*kept, prompt).mapInArrow(run, schema)


def call_events(outputs: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys..., event fields): one row for each attempt."""
    return outputs.select(*keys, F.inline("calls"))


@dataclass(frozen=True)
class RuleModel:
    """A deterministic stand-in for a language model: patterns for labels, read from the prompt's input text."""

    rules: tuple[tuple[str, str], ...] = (
        ("medication", r"\b[A-Z][a-z]+(?:azole|mycin|zumab|statin|pril|vir|dex|trine|lone|fate|quine)\b"),
        ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
        ("dose", r"\b\d+(?:\.\d+)? (?:mg|mL|µg)\b"),
        ("organization", r"\b[A-Z]\w+ (?:Trust|Clinic|Institute|Laboratories|Holdings)\b"),
    )
    begin: str = "\nInput text:\n"
    end: str = "\n\nReturn "

    def __call__(self, prompt: str, settings: Mapping[str, Any]) -> str:
        text = prompt.rpartition(self.begin)[2].rpartition(self.end)[0] if self.begin in prompt else prompt
        found = sorted((m.start(), label, m[0]) for label, p in self.rules for m in re.finditer(p, text))
        return json.dumps({"extractions": [{"text": t, "label": label, "confidence": 0.9} for _, label, t in found]}, ensure_ascii=False)

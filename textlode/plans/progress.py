"""How far a running model stage is: counts from the executors, and a line on the driver's terminal."""

from __future__ import annotations

import os
import sys
import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import SparkSession

from textlode.operators.viz import progress_line


@dataclass(frozen=True)
class Step:
    """Chunks and characters done so far, of all passes together."""

    completed_chunks: int
    total_chunks: int
    processed_chars: int
    total_chars: int


def wants_line(stream: TextIO | None = None) -> bool:
    """Whether a progress line is written: to a terminal, and not in continuous integration."""
    stream = stream or sys.stderr
    return stream.isatty() and os.environ.get("CI", "").lower() != "true"


class Watch:
    """Counts what the executors report and tells listeners about it while a stage runs.

    Executors add to accumulators, whose values reach the driver as tasks end; a
    task that is repeated may count twice, so figures are cut at their totals.
    """

    def __init__(self, spark: SparkSession, total_chunks: int, total_chars: int, listener: Callable[[Step], Any] | None = None, model: str | None = None, stream: TextIO | None = None, every: float = 0.5):
        self.chunks, self.chars = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self.total_chunks, self.total_chars = total_chunks, total_chars
        self.listener, self.model, self.stream, self.every = listener, model, stream, every
        self._stop = threading.Event()
        self._last: Step | None = None
        self._written = False

    def reporter(self) -> Callable[[int, int], None]:
        """What an executor calls with the chunks and characters of a batch."""
        chunks, chars = self.chunks, self.chars

        def report(n: int, size: int) -> None:
            chunks.add(n)
            chars.add(size)

        return report

    def step(self) -> Step:
        return Step(min(self.chunks.value, self.total_chunks), self.total_chunks, min(self.chars.value, self.total_chars), self.total_chars)

    def _tell(self) -> None:
        now = self.step()
        if now == self._last:
            return
        before = self._last.processed_chars if self._last else 0
        self._last = now
        if self.listener:
            self.listener(now)
        if self.stream:
            self.stream.write("\r" + progress_line(self.model, now.processed_chars - before, now.processed_chars))
            self.stream.flush()
            self._written = True

    def _run(self) -> None:
        while not self._stop.wait(self.every):
            self._tell()

    def __enter__(self) -> Watch:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()
        self._tell()
        if self._written and self.stream:
            self.stream.write("\n")

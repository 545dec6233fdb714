"""Settings of a run, and a timer."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Folders and reader sizes; each operator takes what it needs as parameters."""

    root: str = "out"
    reader_width: float = 700.0
    grid: int = 100
    topics: int = 8
    topic_iterations: int = 50
    dropped_words: int = 100
    length_limit: int = 20_000

    @property
    def reader_height(self) -> float:
        return 2**0.5 * self.reader_width


@contextmanager
def timed(name: str) -> Iterator[None]:
    """Log the milliseconds that a block takes."""
    began = time.perf_counter()
    try:
        yield
    finally:
        logging.getLogger("quirelight").info("%s: %.0f ms", name, 1000 * (time.perf_counter() - began))

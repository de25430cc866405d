"""Seconds spent on reading values out of sums, apart from drawing, evaluating and summing samples."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

_spent: ContextVar[float] = ContextVar("readout_seconds", default=0.0)


@contextmanager
def readout() -> Iterator[None]:
    """What runs inside is readout."""
    began = time.monotonic()
    try:
        yield
    finally:
        _spent.set(_spent.get() + time.monotonic() - began)


@contextmanager
def watch() -> Iterator[dict[str, float]]:
    """Fills in seconds: elapsed, readout, and regular, which is the rest."""
    found: dict[str, float] = {}
    before, began = _spent.get(), time.monotonic()
    try:
        yield found
    finally:
        found["elapsed"] = time.monotonic() - began
        found["readout"] = _spent.get() - before
        found["regular"] = found["elapsed"] - found["readout"]

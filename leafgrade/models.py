"""Models that a Python worker keeps between tasks, for a limited time."""

from __future__ import annotations

import gc
import os
import threading
import time
from collections.abc import Callable
from typing import Any

TTL_SECONDS = 1800.0
_TTL_VARIABLE = "LEAFGRADE_MODEL_TTL"


def time_limit(default: float = TTL_SECONDS) -> float:
    """Seconds that models are kept: the environment's value where it is a number."""
    try:
        return float(os.environ[_TTL_VARIABLE])
    except (KeyError, ValueError):
        return default


class Shelf:
    """Loaded models by name, one load for each at a time; one not asked for within its time goes."""

    def __init__(self, seconds: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.seconds = time_limit() if seconds is None else seconds
        self.clock = clock
        self.lock = threading.RLock()
        self.held: dict[str, tuple[Any, float]] = {}

    def get(self, name: str, load: Callable[[], Any]) -> tuple[Any, float]:
        """The model and the seconds that loading took (0 if it was there)."""
        with self.lock:
            self.expire()
            if name in self.held:
                model, spent = self.held[name][0], 0.0
            else:
                began = time.perf_counter()
                model = load()
                spent = time.perf_counter() - began
            self.held[name] = (model, self.clock())
            return model, spent

    def expire(self) -> None:
        with self.lock:
            old = [k for k, (_, used) in self.held.items() if self.clock() - used > self.seconds]
            for k in old:
                del self.held[k]
        if old:
            gc.collect()

    def loaded(self) -> bool:
        self.expire()
        return bool(self.held)

    def drop(self) -> None:
        with self.lock:
            self.held.clear()
        gc.collect()


_shelf: Shelf | None = None


def shelf() -> Shelf:
    """The shelf of this process (a Python worker serves many tasks)."""
    global _shelf
    if _shelf is None:
        _shelf = Shelf()
    return _shelf

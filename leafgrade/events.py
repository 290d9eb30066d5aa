"""What a run tells while it goes on: one kind of record, and anything callable may receive it."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime


@dataclass(frozen=True)
class Event:
    """`what` happened in `stage` (started, counted, loaded, finished, failed), with its figures."""

    stage: str
    what: str
    figures: Mapping[str, float | int | str] = field(default_factory=dict)
    at: datetime = field(default_factory=lambda: datetime.now(UTC))

    def __str__(self) -> str:
        return " ".join([self.stage, self.what, *(f"{k}={v}" for k, v in self.figures.items())])


Receiver = Callable[[Event], None]


def to_log(log: logging.Logger | None = None, level: int = logging.INFO) -> Receiver:
    log = log or logging.getLogger("leafgrade")
    return lambda event: log.log(level, "%s", event)


class Teller:
    """Hands events to all receivers; one that raises is logged and does not stop a run."""

    def __init__(self, receivers: Receiver | Iterable[Receiver] | None = None):
        self.receivers = [receivers] if callable(receivers) else list(receivers or [])

    def __call__(self, stage: str, what: str, **figures: float | int | str) -> None:
        event = Event(stage, what, figures)
        for receive in self.receivers:
            try:
                receive(event)
            except Exception:
                logging.getLogger("leafgrade").exception("a receiver failed on: %s", event)


def worker_log(name: str = "leafgrade.worker") -> logging.Logger:
    """A log for code in Python workers: lines name stage, partition and attempt, and go to the executor's own log."""
    from pyspark import TaskContext

    log = logging.getLogger(name)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
        log.propagate = False
    context = TaskContext.get()
    where = f"stage {context.stageId()} partition {context.partitionId()} attempt {context.attemptNumber()}" if context else "driver"
    log.handlers[0].setFormatter(logging.Formatter(f"%(asctime)s %(levelname)s {where}: %(message)s"))
    return log

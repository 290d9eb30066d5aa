"""Runs on request: at once, or as jobs that are asked about later and forgotten after a time.

The session does the work of all jobs; a job is a thread that plans and waits. Jobs can be listed as a
table, on which expiry is a filter.
"""

from __future__ import annotations

import logging
import logging.handlers
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import LeafgradeError, RunConfig
from .engines import PageEngine, PageReader, form_feed_reader
from .events import Event
from .models import shelf
from .operators.batching import parse_page_range
from .operators.rollups import batch_summary
from .pipeline import run
from .readiness import memory_report
from .sources import discovered

JOB_SECONDS = 3600
JOBS = "id string, status string, created double, error string"


def is_expired(status: Column, created: Column, now: Column, seconds: float = JOB_SECONDS) -> Column:
    """Whether a job is over and was begun longer ago than `seconds`."""
    return status.isin("completed", "failed") & ((now - created) > seconds)


@dataclass
class Job:
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "running"
    created: float = field(default_factory=time.time)
    told: dict[str, Any] = field(default_factory=dict)
    result: dict[str, Any] | None = None
    error: str | None = None

    def receive(self, event: Event) -> None:
        self.told = {"stage": event.stage, "what": event.what, **event.figures}


def rotating_log(path: str, size: int = 10 << 20, files: int = 3) -> logging.Logger:
    log = logging.getLogger("leafgrade")
    log.addHandler(logging.handlers.RotatingFileHandler(path, maxBytes=size, backupCount=files))
    log.setLevel(logging.INFO)
    return log


def _only(reader: PageReader, first: int, last: int) -> PageReader:
    return lambda content: reader(content)[first : last + 1]


class Service:
    """`with Service(...) as s:` loads models first if asked, and gives them up at the end."""

    def __init__(self, spark: SparkSession, vocab: DataFrame, reader: PageReader = form_feed_reader, make_engine: Callable[[], PageEngine] | None = None, first_engine: PageReader | None = None, warm: Callable[[], None] | None = None, device: str = "cpu"):
        self.spark, self.vocab, self.reader, self.make_engine, self.first_engine = spark, vocab, reader, make_engine, first_engine
        self.warm, self.device = warm, device
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()

    def __enter__(self) -> Service:
        if self.warm:
            self.warm()
        return self

    def __exit__(self, *_: object) -> None:
        shelf().drop()

    def _result(self, config: RunConfig, receivers=None, output_name: str | None = None, page_range: str | None = None) -> dict[str, Any]:
        if not config.input_dir.strip():
            raise LeafgradeError("no input folder is given")
        reader = self.reader
        if page_range is not None:
            found, _ = discovered(self.spark, config.input_dir, config.pattern, config.recursive, config.files)
            if found.count() != 1:
                raise LeafgradeError("a page range is for a run of one file")
            first, last = parse_page_range(page_range, len(reader(bytes(found.first().content))))
            reader = _only(reader, first, last)
        files, _ = run(self.spark, config, self.vocab, reader, self.make_engine, self.first_engine, receivers)
        if output_name is not None:
            files = sinks.named_output(files, output_name)
        counts = batch_summary(files).first()
        # The answer lists the files asked for; pages and texts stay in the output folder.
        return {**counts.asDict(), "files": [r.asDict(recursive=True) for r in files.orderBy("path").collect()]}

    def ocr(self, config: RunConfig, output_name: str | None = None, page_range: str | None = None) -> dict[str, Any]:
        """Runs now; the record of the batch, or {"error": ...}."""
        try:
            return self._result(config, output_name=output_name, page_range=page_range)
        except Exception as e:  # noqa: BLE001 - the caller gets an answer in any case
            logging.getLogger("leafgrade").exception("a run of %s failed", config.input_dir)
            return {"error": f"{e} (input {config.input_dir!r})"}

    def start(self, config: RunConfig) -> dict[str, str]:
        """Begins a job and returns its id."""
        self.forget_expired()
        job = Job()

        def work() -> None:
            try:
                job.result = self._result(config, job.receive)
                job.status = "completed"
            except Exception as e:  # noqa: BLE001 - the job carries it
                job.error, job.status = str(e), "failed"
                logging.getLogger("leafgrade").exception("job %s failed", job.id)

        with self.lock:
            self.jobs[job.id] = job
        threading.Thread(target=work, name=f"leafgrade-{job.id}", daemon=True).start()
        return {"job_id": job.id, "status": job.status}

    def status(self, job_id: str) -> dict[str, Any]:
        self.forget_expired()
        job = self.jobs.get(job_id)
        return asdict(job) if job else {"error": f"no job {job_id!r}"}

    def table(self) -> DataFrame:
        with self.lock:
            rows = [(j.id, j.status, j.created, j.error) for j in self.jobs.values()]
        return self.spark.createDataFrame(rows, JOBS)

    def forget_expired(self, now: float | None = None) -> list[str]:
        """Drops jobs that are over for long; their ids."""
        now = time.time() if now is None else now
        with self.lock:
            old = [k for k, j in self.jobs.items() if j.status in ("completed", "failed") and now - j.created > JOB_SECONDS]
            for k in old:
                del self.jobs[k]
        return old

    def memory(self) -> dict[str, Any]:
        return memory_report(self.device) | {"models_loaded": shelf().loaded(), "model_seconds": shelf().seconds}


def expired_jobs(jobs: DataFrame, now: float | Column, seconds: float = JOB_SECONDS) -> DataFrame:
    """The jobs (id, status, created in epoch seconds) of a table that may be forgotten."""
    now = now if isinstance(now, Column) else F.lit(now)
    return jobs.where(is_expired(F.col("status"), F.col("created"), now, seconds))

"""Producers as jobs: a registry, cost classes as scheduler pools, and a record per run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

#: Jobs of a cost class that may run at once; None has no bound.
CAPACITY: dict[str, int | None] = {"scraping": 1, "box": 1, "local": None}


@dataclass
class Job:
    id: str
    producer: str
    trigger: str
    state: str = "running"
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    started: datetime = field(default_factory=lambda: datetime.now(UTC))
    finished: datetime | None = None
    thread: threading.Thread | None = None


@dataclass(frozen=True)
class Producer:
    """``produce(spark)`` yields proposal DataFrames; each is recorded as it comes, so a later failure keeps it."""

    name: str
    produce: Callable[[SparkSession], Iterable[DataFrame]]
    cost: str = "local"


class JobRunner:
    """Runs producers in threads, each in the FAIR pool of its cost class; ``record`` writes a batch and counts it."""

    def __init__(self, spark: SparkSession, record: Callable[[DataFrame], dict[str, int]], keep: int = 200):
        self.spark, self.record, self.keep, self.evicted = spark, record, keep, 0
        self._producers: dict[str, Producer] = {}
        self._jobs: dict[str, Job] = {}
        self._lock = threading.RLock()
        self._closed = False

    def register(self, producer: Producer) -> None:
        with self._lock:
            if producer.name in self._producers:
                raise ValueError(f"{producer.name} is registered")
            if producer.cost not in CAPACITY:
                raise ValueError(f"unknown cost class {producer.cost!r}")
            self._producers[producer.name] = producer

    def reregister(self, producer: Producer) -> None:
        with self._lock:
            if producer.name not in self._producers:
                raise KeyError(producer.name)
            self._producers[producer.name] = producer

    def producers(self) -> list[str]:
        return sorted(self._producers)

    def start(self, name: str, trigger: str = "manual") -> Job:
        """Starts a producer; raises if it runs already or its cost class is full."""
        with self._lock:
            if self._closed:
                raise RuntimeError("the runner is closed")
            producer = self._producers[name]
            running = [j for j in self._jobs.values() if j.state == "running"]
            if any(j.producer == name for j in running):
                raise RuntimeError(f"{name} is running")
            room = CAPACITY[producer.cost]
            if room is not None and sum(self._producers[j.producer].cost == producer.cost for j in running) >= room:
                raise RuntimeError(f"no room for another {producer.cost} job")
            job = Job(uuid.uuid4().hex, name, trigger)
            self._jobs[job.id] = job
            job.thread = threading.Thread(target=self._run, args=(job, producer), daemon=True)
            job.thread.start()
            return job

    def _run(self, job: Job, producer: Producer) -> None:
        try:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", producer.cost)
            batches = producer.produce(self.spark)
            if isinstance(batches, DataFrame) or not hasattr(batches, "__iter__"):
                raise TypeError(f"{producer.name} must yield DataFrames")
            for batch in batches:
                for k, n in self.record(batch).items():
                    job.counts[k] = job.counts.get(k, 0) + n
            job.state = "finished"
        except Exception as e:  # the failure is the job's outcome
            job.state, job.error = "failed", f"{type(e).__name__}: {e}"
        finally:
            job.finished = datetime.now(UTC)
            self._retire()

    def _retire(self) -> None:
        with self._lock:
            done = sorted((j for j in self._jobs.values() if j.finished), key=lambda j: j.finished)
            for j in done[: max(0, len(done) - self.keep)]:
                del self._jobs[j.id]
                self.evicted += 1

    def job(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def jobs(self) -> list[Job]:
        return sorted(self._jobs.values(), key=lambda j: j.started, reverse=True)

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        job = self._jobs[job_id]
        job.thread.join(timeout)
        return job

    def close(self, timeout: float | None = None) -> None:
        """Takes no more jobs and waits for those that run."""
        self._closed = True
        for job in self.jobs():
            if job.thread and job.state == "running":
                job.thread.join(timeout)


class Ticker:
    """Calls ``tick`` every ``seconds`` on a thread until closed; an exception is kept and does not end it."""

    def __init__(self, tick: Callable[[datetime], None], seconds: float = 60.0):
        self.tick, self.seconds, self.last_error = tick, seconds, None
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def start(self) -> None:
        if self._thread:
            raise RuntimeError("the ticker runs")
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        while not self._stop.is_set():
            try:
                self.tick(datetime.now(UTC))
            except Exception as e:  # the next tick may succeed
                self.last_error = e
            self._stop.wait(self.seconds)

    def close(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()

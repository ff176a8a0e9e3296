"""Runs that can be cancelled by their id while others go on.

All jobs that a run starts within ``running`` carry its id as a job tag. ``cancel`` cancels these jobs, stops the run's streams
and records the run as cancelled before that, so that code of the run which asks ``check`` stops at its next step too. What a run
has not committed to a store is as if it had never been.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

PREFIX = "run-"


class Cancelled(RuntimeError):
    """The run was cancelled."""


class Runs:
    """The runs of a driver and their states: running, done, failed, cancelled."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.states: dict[str, str] = {}
        self.streams: dict[str, list[StreamingQuery]] = {}
        self._lock = threading.Lock()

    @contextmanager
    def running(self, run: str) -> Iterator[None]:
        """The body's jobs belong to the run. Whatever ends a cancelled run is raised as Cancelled; an id is used once."""
        with self._lock:
            if run in self.states:
                if self.states[run] == "cancelled":
                    raise Cancelled(run)
                raise ValueError(f"run {run} was there before")
            self.states[run] = "running"
        self.spark.sparkContext.setInterruptOnCancel(True)
        self.spark.sparkContext.addJobTag(PREFIX + run)
        try:
            yield
            self.check(run)
        except Exception as e:
            with self._lock:
                cancelled = self.states[run] == "cancelled"
                self.states[run] = "cancelled" if cancelled else "failed"
            if cancelled and not isinstance(e, Cancelled):
                raise Cancelled(run) from e
            raise
        else:
            with self._lock:
                self.states[run] = "done"
        finally:
            self.spark.sparkContext.removeJobTag(PREFIX + run)

    def stream(self, run: str, query: StreamingQuery) -> StreamingQuery:
        """A stream that stops with the run."""
        with self._lock:
            self.streams.setdefault(run, []).append(query)
            stopped = self.states.get(run) == "cancelled"
        if stopped:
            query.stop()
        return query

    def check(self, run: str) -> None:
        """Raises Cancelled where the run was cancelled; for code between two jobs."""
        if self.states.get(run) == "cancelled":
            raise Cancelled(run)

    def cancel(self, run: str) -> bool:
        """Whether there was something to cancel. A run that has not begun yet never will."""
        with self._lock:
            if self.states.get(run) in ("done", "failed", "cancelled"):
                return False
            self.states[run] = "cancelled"
            streams = self.streams.get(run, [])
        self.spark.sparkContext.cancelJobsWithTag(PREFIX + run)
        for query in streams:
            query.stop()
        return True

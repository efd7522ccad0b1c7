"""Rows and seconds of each batch of a stream, read off its own progress reports."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

METRIC = "batch_rows"


@dataclass(frozen=True)
class BatchMetrics:
    batch: int
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else 0.0


def observed(stream: DataFrame, name: str = METRIC) -> DataFrame:
    """The stream, with its rows counted as they pass; the count costs no scan of its own."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))


class BatchLog(StreamingQueryListener):
    """Metrics of the batches of streams that carry :func:`observed`, in the order Spark reports them.

    Register it before the stream starts (``spark.streams.addListener(log)``). Reports come from another thread: ``wait(query)`` returns when
    the last one of an ended query is in. Batches without rows are reported only if Spark runs them.
    """

    def __init__(self, name: str = METRIC):
        self.name = name
        self._batches: dict[str, list[BatchMetrics]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _event(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is not None:
            seconds = progress.durationMs.get("triggerExecution", progress.batchDuration) / 1000
            with self._lock:
                self._batches.setdefault(str(progress.runId), []).append(BatchMetrics(progress.batchId, row["rows"], seconds))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> list[BatchMetrics]:
        query.awaitTermination()
        if not self._event(str(query.runId)).wait(seconds):
            raise TimeoutError("the stream's last report didn't arrive")
        with self._lock:
            return list(self._batches.get(str(query.runId), []))

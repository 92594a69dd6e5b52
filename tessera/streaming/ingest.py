"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.point_table import PointTable
from ..trace import logger, trace

log = logger(__name__)

def ingest_stream(chunks: DataFrame, table: PointTable, embed, checkpoint: str):
    """Upserts each micro-batch; unchanged chunks are not embedded again. Runs until the input ends. A batch's
    points are seen at once, when its run is complete, or not at all."""

    def upsert(batch: DataFrame, number: int) -> None:
        table.upsert(batch, embed)
        trace(log, "ingest.batch", batch=number, **table.counts)

    return chunks.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Ingest:
    """The status of an ingest, as its streaming query tells it: pending, running, completed, error, cancelled
    or blocked.

    ``start`` gives a streaming query, which runs in the background by itself. ``join`` waits for it and starts
    a failed one again, from its checkpoint, up to ``retries`` times, ``pause`` seconds apart. ``blocked`` says
    why the table can't be written to, if it can't.
    """

    def __init__(self, start: Callable[[], object], blocked: str | None = None, retries: int = 0, pause: float = 5.0):
        self._start, self._left, self._pause, self._blocked = start, retries, pause, blocked
        self._query, self._error, self._state = None, None, "blocked" if blocked else "pending"

    def run(self) -> Ingest:
        """Starts it; does nothing unless it is pending."""
        if self._state == "pending":
            self._launch()
        return self

    def _launch(self) -> None:
        self._state, self._error = "started", None
        try:
            self._query = self._start()
        except Exception as error:  # noqa: BLE001 - the status tells of it
            self._query, self._error = None, error

    @property
    def status(self) -> str:
        if self._state != "started":
            return self._state
        if self._error is not None or self._query is not None and self._query.exception() is not None:
            return "error"
        return "running" if self._query is not None and self._query.isActive else "completed"

    @property
    def message(self) -> str:
        found = self._error or (self._query.exception() if self._query is not None else None)
        return self._blocked or (f"{type(found).__name__}: {found}"[:500] if found is not None else "")

    def cancel(self) -> None:
        if self.status == "running":
            self._query.stop()
            self._state = "cancelled"

    def join(self, timeout: float | None = None) -> str:
        end = None if timeout is None else time.monotonic() + timeout
        while self._state == "started":
            if self._query is not None and self._query.isActive:
                with contextlib.suppress(StreamingQueryException):  # the status tells of it
                    self._query.awaitTermination(None if end is None else max(1, int(end - time.monotonic())))
            if self.status != "error" or not self._left or (end is not None and time.monotonic() > end):
                break
            self._left -= 1
            time.sleep(self._pause)
            self._launch()
        return self.status


def first_seen(rows: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen before, within the watermark if a time column is given."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")

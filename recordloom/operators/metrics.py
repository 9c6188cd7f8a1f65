"""How fast a run goes: rows a second and seconds left, read off the run itself.

The rows are counted by Spark while the run's own action passes over them, so nothing is read twice.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Progress(NamedTuple):
    rows: int
    seconds: float
    rows_per_second: float
    #: Of the rows that are known to be left; None if nobody knows, or nothing has been done yet.
    seconds_left: float | None


def progress(rows: int, seconds: float, total: int | None = None) -> Progress:
    speed = rows / seconds if seconds > 0 else 0.0
    return Progress(rows, seconds, speed, max(total - rows, 0) / speed if total is not None and speed > 0 else None)


class Meter:
    """Counts what passes through a DataFrame: run an action on over(df), then read progress().

    The clock starts with over() and stops where the counts are first read after the action.
    """

    def __init__(self, name: str = "run") -> None:
        self.observation = Observation(name)
        self.seconds: float | None = None

    def over(self, df: DataFrame, **more) -> DataFrame:  # noqa: ANN003
        """df whose rows are counted; more: further aggregates by name."""
        self.began = time.monotonic()
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in more.items()))

    def counts(self) -> dict:
        found = self.observation.get
        if self.seconds is None:
            self.seconds = time.monotonic() - self.began
        return found

    def progress(self, total: int | None = None) -> Progress:
        rows = self.counts()["rows"]
        return progress(rows, self.seconds, total)


def stream_progress(query: StreamingQuery, total: int | None = None) -> Progress:
    """What a stream has done so far, by its own reports: all rows read, over the time that its batches took."""
    reports = {p["batchId"]: p for p in (r if isinstance(r, dict) else dict(batchId=r.batchId, numInputRows=r.numInputRows, durationMs=r.durationMs) for r in query.recentProgress)}
    rows = sum(p["numInputRows"] or 0 for p in reports.values())
    return progress(rows, sum(p["durationMs"].get("triggerExecution", 0) for p in reports.values()) / 1000, total)

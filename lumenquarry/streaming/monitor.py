"""Progress of running streams as rows, in place of a live dashboard."""

from __future__ import annotations

import json
import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COLUMNS = "name string, batch long, rows long, rows_in double, rows_done double, state_rows long"


class Progress(StreamingQueryListener):
    """Keeps the last ``kept`` reports; ``rate`` is what was done in a second lately."""

    def __init__(self, kept: int = 60):
        self.reports: deque = deque(maxlen=kept)
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        return

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.reports.append((p.get("name"), p.get("batchId"), p.get("numInputRows"), p.get("inputRowsPerSecond"), p.get("processedRowsPerSecond"), sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))))

    def rate(self) -> float:
        return float(self.reports[-1][4] or 0.0) if self.reports else 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        typed = [(n, b, r, None if i is None else float(i), None if d is None else float(d), s) for n, b, r, i, d, s in list(self.reports)]
        return spark.createDataFrame(typed, COLUMNS)


def settle(progress: Progress, run_id: str, seconds: float = 10.0) -> bool:
    """Wait until the end of a run was reported: listeners hear of things some time after they happen."""
    until = time.monotonic() + seconds
    while run_id not in progress.ended and time.monotonic() < until:
        time.sleep(0.02)
    return run_id in progress.ended


def watch(spark: SparkSession, kept: int = 60) -> Progress:
    listener = Progress(kept)
    spark.streams.addListener(listener)
    return listener

"""What a run has done so far, told as it goes: metrics that Spark gathers while it works anyway, no counting afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows, and aggregates of them that are there once an action has gone through them."""
    seen = Observation(name)
    return rows.observe(seen, *(m.alias(k) for k, m in metrics.items())), seen


class StreamProgress(StreamingQueryListener):
    """Tells ``report`` of each micro-batch of the named query: {batch, rows, watermark}, and of its end: {error}. Register it with ``spark.streams.addListener``."""

    def __init__(self, query: str, report: Callable[[dict], None]):
        self.query, self.report, self.ids = query, report, set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.query:
            self.ids.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.query:
            self.report({"batch": p.batchId, "rows": p.numInputRows, "watermark": p.eventTime.get("watermark")})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.ids:
            self.report({"error": None if event.exception is None else event.errorClassOnException or "failed"})

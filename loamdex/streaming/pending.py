"""Changes that outlive the driver: a log of what still has to be flushed.

Every micro-batch is written to the log under its id before anything else happens. A
flush gets all that is in the log, merged: on each path the newest batch's operation,
and a reconcile in place of all of them. If it succeeds, the log is marked as done up
to there; if it fails, or the driver dies, everything is still in the log and is merged
under the next batch. Replayed micro-batches write the same entries again. Changes stay
DataFrames throughout; the driver reads one small state file.

The log belongs to one streaming query and its checkpoint, whose batch ids it uses.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import SharedFolder
from ..sources.notes import normalized_events
from .sync import GAP_MS, coalesced

ENTRIES = "reconcile_all boolean, path string, op string, batch long"


class PendingLog:
    """State in ``_STATE``: the epoch, whether flushing is paused, the last batch that is done, and whether a reconcile is due."""

    def __init__(self, spark: SparkSession, root: str, flush: Callable[[DataFrame, bool, Callable[[], bool]], None], has_index: Callable[[], bool] = lambda: True, on_error: Callable[[Exception], None] = lambda e: None):
        """flush: gets the pending operations (path, op), whether to reconcile instead, and a guard that has to hold when it commits."""
        self.spark, self.folder = spark, SharedFolder(spark, root)
        self.flush, self.has_index, self.on_error = flush, has_index, on_error

    def state(self) -> dict:
        return {"epoch": 0, "paused": False, "done": -1, "reconcile": False} | json.loads(self.folder.read("_STATE") or "{}")

    def _set(self, **changes) -> dict:
        state = self.state() | changes
        self.folder.replace("_STATE", json.dumps(state))
        return state

    def _batches(self) -> list[int]:
        return sorted(int(name.removeprefix("batch=")) for name in self.folder.names("log") if name.startswith("batch="))

    def pending(self) -> DataFrame:
        """(path, op): the last operation on each path of the batches that aren't done."""
        waiting = [b for b in self._batches() if b > self.state()["done"]]
        if not waiting:
            return self.spark.createDataFrame([], "path string, op string")
        rows = self.spark.read.schema(ENTRIES).parquet(*(self.folder.at(f"log/batch={b}/entries") for b in waiting))
        return rows.where("path IS NOT NULL").groupBy("path").agg(F.max_by("op", "batch").alias("op"))

    def _reconcile_due(self, state: dict) -> bool:
        waiting = [self.folder.at(f"log/batch={b}/entries") for b in self._batches() if b > state["done"]]
        return state["reconcile"] or (bool(waiting) and not self.spark.read.schema(ENTRIES).parquet(*waiting).where("reconcile_all").isEmpty())

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of normalised changes."""
        if batch_id > self.state()["done"]:
            entries = coalesced(batch.withColumn("session", F.lit(0))).select("reconcile_all", "path", "op", F.lit(batch_id).cast("long").alias("batch"))
            entries.write.mode("overwrite").parquet(self.folder.at(f"log/batch={batch_id}/entries"))
        self.run()

    def run(self) -> bool:
        """Flush what is pending; False if there was nothing to do, it may not be done now, or it failed and stays."""
        state, batches = self.state(), self._batches()
        waiting = [b for b in batches if b > state["done"]]
        if state["paused"] or not self.has_index() or not (waiting or state["reconcile"]):
            return False
        reconcile = self._reconcile_due(state)
        pending = self.pending().limit(0) if reconcile else self.pending()
        if not reconcile and pending.isEmpty():
            self._finish(state, waiting)
            return False
        try:
            self.flush(pending, reconcile, lambda: self.state()["epoch"] == state["epoch"])
        except Exception as e:  # everything stays in the log
            try:
                self.on_error(e)
            except Exception:  # reporting must not stop the stream
                pass
            return False
        return self._finish(state, waiting)

    def _finish(self, state: dict, waiting: list[int]) -> bool:
        if self.state()["epoch"] != state["epoch"]:
            return False
        self._set(done=max([state["done"], *waiting]), reconcile=False)
        for b in waiting:
            self.folder.delete(f"log/batch={b}")
        return True

    def reconfigure(self, paused: bool, keep: bool = True, reconcile: bool = False) -> None:
        """Begin a new epoch: what was begun in an older one may not commit and stays pending, unless ``keep`` is false."""
        state, batches = self.state(), self._batches()
        done = state["done"] if keep else max([state["done"], *batches])
        self._set(epoch=state["epoch"] + 1, paused=paused, done=done, reconcile=reconcile or (keep and state["reconcile"]))
        for b in batches if not keep else []:
            self.folder.delete(f"log/batch={b}")


def follow_durably(events: DataFrame, log: PendingLog, checkpoint: str, **trigger):
    """Start a streaming query over file events; flushes are serial, and what they leave undone is in the log."""
    return normalized_events(events).writeStream.foreachBatch(log.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{GAP_MS} milliseconds"})).start()

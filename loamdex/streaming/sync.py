"""Change streams coalesced into atomic sync batches.

One timer for all paths: a batch ends when nothing has happened for ``gap``. In a
batch the last operation on a path wins, and a reconcile supersedes all of them.
Over a table ``sync_batches`` does this with windows; ``follow`` does it on a stream,
one flush per micro-batch: a file source's batch is what has gathered since the
last flush, flushes never overlap, and a failed one is carried under what is newer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import parted
from ..sources.notes import normalized_events

GAP_MS = 1500


def sessions(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Events with ``session``; an event exactly a gap later belongs to the batch before.

    The timer is global, so order is global: gaps are found within slices of the order
    with about equally many events, and only slice edges meet in one place.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = parted(events.withColumn("_ms", ms), F.struct("_ms", "seq"), "_slice")
    order = Window.partitionBy("_slice").orderBy("_ms", "seq")
    # the last event of the slice before, from one row per slice
    edges = rows.groupBy("_slice").agg(F.min("_ms").alias("lo"), F.max("_ms").alias("hi"))
    edges = edges.select("_slice", F.lag("hi").over(Window.orderBy("_slice")).alias("_before"))
    rows = rows.join(edges, "_slice").withColumn("_last", F.coalesce(F.lag("_ms").over(order), F.col("_before")))
    rows = rows.withColumn("_new", (F.col("_last").isNull() | (F.col("_ms") - F.col("_last") > gap_ms)).cast("long"))
    counts = rows.groupBy("_slice").agg(F.sum("_new").alias("n"))
    counts = counts.select("_slice", F.coalesce(F.sum("n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_k", inside).join(counts, "_slice").withColumn("session", F.col("_first") + F.col("_k")).drop("_ms", "_slice", "_before", "_last", "_new", "_k", "_first")


def coalesced(changes: DataFrame, key: str = "session") -> DataFrame:
    """(key, reconcile_all, path, op): last operation per path; a batch with a reconcile has that alone."""
    all_ = changes.groupBy(key).agg((F.count_if(F.col("op") == "reconcile") > 0).alias("reconcile_all"))
    last = changes.where("op <> 'reconcile'").groupBy(key, "path").agg(F.max_by("op", F.struct("ts", "seq", "part")).alias("op"))
    return all_.join(last, key, "left").withColumns({"path": F.when(~F.col("reconcile_all"), F.col("path")), "op": F.when(~F.col("reconcile_all"), F.col("op"))}).distinct()


def sync_batches(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """One row per path and batch of file events (op, path, new_path, ts, seq); events of other files than notes don't count, nor hold a batch open."""
    return coalesced(sessions(normalized_events(events), gap_ms))


class AutoSync:
    """State of a followed stream: epoch, pause, and what failed batches left to do."""

    def __init__(self, flush: Callable[[dict], None], has_index: Callable[[], bool] = lambda: True, on_error: Callable[[Exception], None] = lambda e: None):
        self.flush, self.has_index, self.on_error = flush, has_index, on_error
        self.epoch, self.paused = 0, False
        self.pending: dict[str, str] = {}
        self.reconcile = False

    def reconfigure(self, paused: bool, keep: bool = True, reconcile: bool = False) -> None:
        """Begin a new epoch: batches of older ones may not commit any more."""
        self.epoch += 1
        self.paused = paused
        if not keep:
            self.pending, self.reconcile = {}, False
        self.reconcile |= reconcile

    def should_commit(self, epoch: int) -> bool:
        return epoch == self.epoch and not self.paused

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of normalised changes; only the few paths that changed reach the driver."""
        rows = coalesced(batch.withColumn("session", F.lit(0))).collect()
        if any(r.reconcile_all for r in rows):
            self.pending, self.reconcile = {}, True
        elif not self.reconcile:
            self.pending |= {r.path: r.op for r in rows if r.path is not None}
        self.run()

    def run(self) -> None:
        if self.paused or not self.has_index() or not (self.pending or self.reconcile):
            return
        ops, reconcile = ({}, True) if self.reconcile else (self.pending, False)
        batch = {"epoch": self.epoch, "reconcile_all": reconcile, "upserts": sorted(p for p, op in ops.items() if op == "upsert"), "deletes": sorted(p for p, op in ops.items() if op == "delete")}
        self.pending, self.reconcile = {}, False
        try:
            self.flush(batch)
        except Exception as e:  # the batch is carried under whatever is newer
            self.reconcile |= reconcile
            self.pending = {} if self.reconcile else {**ops, **self.pending}
            self.on_error(e)


def follow(events: DataFrame, sync: AutoSync, checkpoint: str, **trigger):
    """Start a streaming query over file events; flushes are serial."""
    return normalized_events(events).writeStream.foreachBatch(sync.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{GAP_MS} milliseconds"})).start()


def session_counts(events: DataFrame, gap_ms: int = GAP_MS, late: str = "10 minutes") -> DataFrame:
    """Batches of a stream in event time: (start, end, changes); rows later than the watermark are left out, a reconcile makes up for them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap_ms} milliseconds")).agg(F.count("*").alias("changes")).select("session_window.start", "session_window.end", "changes")

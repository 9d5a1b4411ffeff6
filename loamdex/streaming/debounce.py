"""Debounced change streams with state: the batches of ``sync_batches``, from a stream.

Time is cut in slots as long as the gap, so no batch ends inside a slot: which slots
belong together is told by the first and last event of each, a small aggregation. Changes
wait in keyed states, a vault's dealt out over shards by path; every shard is sent the
slots that the watermark has passed, numbers the batches by them, and keeps the open
batch's last operation for its paths. An event-time timer closes a batch when
nothing followed for ``gap``. State and output survive a restart from the query's
checkpoint. Nothing is collected on the driver.

Slots that the watermark has passed take no more events, for which a reconcile makes up;
the last batch stays open until the watermark passes the slot in which its gap ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.notes import normalized_events
from .sync import GAP_MS

BATCHES = "vault string, session long, reconcile_all boolean, path string, op string"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States that share a vault's paths, and rows of output at a time.
SHARDS, ROWS_OUT = 32, 50_000
CHANGE = ["slot", "ms", "seq", "part", "path", "op"]


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_all().to_pandas()


class Debounce(StatefulProcessor):
    """Changes and passed slots of one shard of a vault to batches."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "changes binary")
        self.open = handle.getValueState("open", "session long, last long, reconcile boolean, ops binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots, changes = [], []
        for part in rows:
            of_slots = part["lo"].notna()
            slots.append(part.loc[of_slots, ["slot", "lo", "hi", "reconcile"]])
            if not of_slots.all():
                changes.append(packed(part.loc[~of_slots, CHANGE].astype({"ms": "int64", "seq": "int64", "part": "int64"})))
        slots = pd.concat(slots)
        if changes:
            self.waiting.appendList([(c,) for c in changes])
        if len(slots):
            yield from self.batches(key, slots.sort_values("slot"), timerValues.getCurrentWatermarkInMs())
        else:
            yield pd.DataFrame(columns=["vault", "session", "reconcile_all", "path", "op"])

    def batches(self, key, slots: pd.DataFrame, passed: int) -> Iterator[pd.DataFrame]:
        """Take the changes of passed slots; all batches that can't go on are put out."""
        at, lo, hi = (slots[c].to_numpy().astype(np.int64) for c in ("slot", "lo", "hi"))
        held = [unpacked(c[0]) for c in self.waiting.get()] if self.waiting.exists() else []
        held = pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: [] for c in CHANGE})
        session, last, reconcile, ops = self.open.get() if self.open.exists() else (0, None, False, None)
        begins = np.concatenate([[last is None or lo[0] - last > self.gap], lo[1:] - hi[:-1] > self.gap])
        numbers = session + np.cumsum(begins)
        taken = held["slot"].isin(at).to_numpy()
        later, held = held[~taken], held[taken].sort_values(["ms", "seq", "part"])
        held["session"] = numbers[np.searchsorted(at, held["slot"].to_numpy().astype(np.int64))]
        if last is not None:
            held = pd.concat([unpacked(ops).assign(session=session), held])
        # the last one of each path
        held = held[["session", "path", "op"]].drop_duplicates(["session", "path"], keep="last")
        whole = set(numbers[slots["reconcile"].to_numpy().astype(bool)].tolist()) | ({session} if reconcile else set())
        held = held[~held["session"].isin(whole)]
        session, last = int(numbers[-1]), int(hi[-1])
        if later.empty:
            self.waiting.clear()
        else:
            self.waiting.put([(packed(later),)])
        mine = held["session"] == session
        self.open.update((session, last, session in whole, packed(held.loc[mine, ["path", "op"]])))
        yield from self.shown(key, held[~mine], whole - {session})
        yield from self.closed(key, passed)

    def closed(self, key, passed: int) -> Iterator[pd.DataFrame]:
        """The open batch, if no slot to come can hold it open; else a timer is set for it."""
        session, last, reconcile, ops = self.open.get() if self.open.exists() else (0, None, False, None)
        if last is None:
            return
        if passed // self.gap * self.gap - last > self.gap:
            self.open.update((session, None, False, None))
            yield from self.shown(key, unpacked(ops).assign(session=session), {session} if reconcile else set())
        else:
            self.handle.registerTimer(-(-(last + self.gap + 1) // self.gap) * self.gap)

    def shown(self, key, ops: pd.DataFrame, whole: set[int]) -> Iterator[pd.DataFrame]:
        """Batches as rows; those with a reconcile are told by the first shard."""
        out = [ops.assign(reconcile_all=False)]
        if key[1] == 0:
            out.append(pd.DataFrame({"session": sorted(whole), "path": None, "op": None, "reconcile_all": True}))
        for rows in out:
            for start in range(0, len(rows), ROWS_OUT):
                yield rows.iloc[start : start + ROWS_OUT].assign(vault=key[0])[["vault", "session", "reconcile_all", "path", "op"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of a batch that went on finds it open, or another one, whose own timer is set
        yield pd.DataFrame(columns=["vault", "session", "reconcile_all", "path", "op"])
        yield from self.closed(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


def debounced(events: DataFrame, gap_ms: int = GAP_MS, late: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """(vault, session, reconcile_all, path, op) of a stream of file events (op, path, new_path, ts, seq[, vault]).

    Sets the session's state store to RocksDB, which keeps such state. A query that goes on
    from a checkpoint needs the same shards.
    """
    spark = events.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    named = events if "vault" in events.columns else events.withColumn("vault", F.lit(""))
    changes = normalized_events(named.withWatermark("ts", late)).withColumn("window", F.window("ts", f"{gap_ms} milliseconds"))
    slot, ms = F.unix_millis("window.start").alias("slot"), F.unix_millis("ts")
    slots = changes.groupBy("vault", "window").agg(F.min(ms).alias("lo"), F.max(ms).alias("hi"), F.bool_or(F.col("op") == "reconcile").alias("reconcile"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    # both kinds of rows come at the end of their slot, so both are late or neither is
    at = F.window_time("window").alias("at")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    passed = slots.select("vault", at, slot, "lo", "hi", "reconcile", *none("long", "ms", "seq"), *none("int", "part"), *none("string", "path", "op"), every)
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard")
    single = changes.where("op <> 'reconcile'").select("vault", at, slot, *none("long", "lo", "hi"), *none("boolean", "reconcile"), ms.alias("ms"), F.col("seq").cast("long").alias("seq"), "part", "path", "op", shard)
    return single.unionByName(passed).groupBy("vault", "shard").transformWithStateInPandas(Debounce(gap_ms), BATCHES, "Append", "EventTime")

"""The index as one object: chunk, compare, embed what changed, commit; and query it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotInitializedError, ValidationError
from ..functions import providers as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunker, delta, search, similarity
from ..operators.shared import checkpointed
from ..sources.store import SCHEMA, GenerationStore
from .progress import observed


class NoteIndex:
    """Notes (path, content) in a generation store, embedded by a provider."""

    def __init__(self, store: GenerationStore, provider: Callable[[], P.EmbeddingProvider], options: chunker.Options = chunker.Options()):
        self.store, self.provider, self.options = store, provider, options
        self.spark: SparkSession = store.spark

    def _committed(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA) if self.store.manifest() is None else self.store.read()

    def chunks(self, notes: DataFrame) -> DataFrame:
        chunks = chunker.chunk_notes(notes, self.options)
        return chunks.withColumn("preview", T.preview("text"))

    def update(self, notes: DataFrame, delete_paths: DataFrame | None = None, mode: str = "partial", should_commit: Callable[[], bool] = lambda: True, automatic: bool = False, on_progress: Callable[[dict], None] = lambda p: None) -> dict:
        """Index notes; ``mode``: partial, sync (with explicit deletes) or reconcile (paths not given go).

        Only new and changed chunks are embedded. A run that changes nothing leaves the
        generation as it is, and so does a failing provider. Unless it is ``automatic``,
        a run turns automatic sync on again after a clear. ``on_progress`` is told how
        many chunks there are, and how many vectors were made, as the jobs that make them end.
        """
        if mode not in ("partial", "sync", "reconcile") or (delete_paths is not None) != (mode == "sync"):
            raise ValidationError("mode is partial, sync with deletes, or reconcile")
        notes = notes.withColumn("path", T.checked_path("path"))
        delta.checked_input(notes, delete_paths)
        before = self.store.manifest()
        # chunks are made once, for the comparison and for embedding
        chunks, chunked = observed(self.chunks(notes), "chunked", chunks=F.count("*"))
        committed, incoming = self._committed(), checkpointed(chunks)
        on_progress({"phase": "chunked", **chunked.get})
        if not delta.collisions(incoming, committed).isEmpty():
            raise ValidationError("a chunk id belongs to another note")
        states = checkpointed(delta.classify(incoming, committed, notes))
        gone = delete_paths if mode == "sync" else delta.missing_paths(notes, committed) if mode == "reconcile" else None
        counts = delta.counters(states, notes, committed, gone).first().asDict()
        counts |= {"generation_before": before.generation if before else 0, "committed": False}
        if counts["chunks_embedded"] or counts["chunks_deleted"] or (before is None and mode == "reconcile"):
            fresh = incoming.join(states.where("status IN ('new', 'changed')").select("id"), "id", "left_semi")
            fresh, embedded = observed(P.embedded(fresh, self.provider).withColumn("vector", V.unit_f32("vector")), "embedded", vectors=F.count("vector"))
            # embedded once: the merge and the ranges of the next generation both read it
            upserts = checkpointed(fresh.select(*committed.columns))
            on_progress({"phase": "embedded", **embedded.get})
            merged = delta.merge(committed, upserts, states.where("status = 'removed'"), gone)
            counts["committed"] = self.store.commit(merged, expected=counts["generation_before"], should_commit=should_commit) is not None
        if not automatic:
            self.store.suspend(False)
        return counts | {"generation_after": counts["generation_before"] + counts["committed"]}

    def flush(self, batch: dict, read: Callable[[list[str] | None], DataFrame], guard: Callable[[], bool] = lambda: True) -> dict | None:
        """Apply an auto-sync batch, from current content; nothing happens before a first explicit index, or between a clear and the next one."""
        if self.store.manifest() is None or self.store.suspended():
            return None
        if batch["reconcile_all"]:
            return self.update(read(None), mode="reconcile", should_commit=guard, automatic=True)
        paths = lambda names: self.spark.createDataFrame([(p,) for p in names], "path string")
        notes = read(batch["upserts"])
        missing = paths(batch["upserts"]).join(notes.select("path"), "path", "left_anti")
        return self.update(notes, paths(batch["deletes"]).union(missing).distinct(), "sync", guard, automatic=True)

    def clear(self) -> None:
        """Empty the index. Automatic sync is off from before that until the next explicit update, also in other sessions."""
        self.store.suspend(True)
        if self.store.manifest() is not None:
            self.store.clear()

    def delete(self, paths: DataFrame) -> dict:
        return self.update(self.spark.createDataFrame([], "path string, content string"), paths, "sync")

    def _ready(self) -> DataFrame:
        if self.store.manifest() is None:
            raise NotInitializedError("there is no index yet")
        return self.store.read()

    def search(self, query: str, limit: int = 10, matches: int = 3, min_score: float | None = None, exclude_paths=()) -> DataFrame:
        """Best documents for a query; an empty index answers without the provider being called."""
        query, rows = search.checked_query(query), self._ready()
        if self.store.manifest().count == 0:
            return self.spark.createDataFrame([], "path string, document_score double, match_rank int, id string, score double")
        (vector,) = P.checked_vectors(self.provider().embed([query]), 1, self.store.dimensions)
        unit = self.spark.createDataFrame([([float(x) for x in vector],)], "v array<double>").select(V.unit_f32("v")).first()[0]
        return search.grouped(rows, unit, limit, matches, min_score=min_score, exclude_paths=exclude_paths)

    def similar(self, path: str, limit: int = 10, matches: int = 3) -> DataFrame:
        return search.similar(self._ready(), path, limit, matches)

    def duplicates(self, threshold: float = 0.95, limit: int = 100, matches: int = 3) -> DataFrame:
        """(left_path, right_path, side, match_rank, id, score, pair_score) of the best pairs."""
        rows = self._ready()
        pairs = similarity.duplicates(search.centroids(rows), threshold, limit)
        found = search.evidence(rows, pairs, matches)
        return found.join(F.broadcast(pairs.select("left_path", "right_path", F.col("score").alias("pair_score"))), ["left_path", "right_path"])

    def status(self) -> str:
        state = self.store.probe()
        return {"absent": "not-initialized", "incomplete": "not-initialized", "corrupt": "error"}.get(state, "ready")

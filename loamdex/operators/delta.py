"""Differences between chunks and a committed index, and how they are merged into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

#: What makes a chunk changed besides its id.
COMPARED = ["path", "ordinal", "content_hash", "preview", "heading_path", "start_offset", "end_offset", "start_line", "end_line"]


def compared(chunks: DataFrame) -> list[str]:
    return [c for c in COMPARED if c in chunks.columns]


def classify(incoming: DataFrame, committed: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, path, status): new, changed, unchanged or removed, over the documents (path) of a run.

    Both sides are matched by id in one full outer join; a committed chunk counts as
    removed only if its document takes part in the run.
    """
    fields = compared(incoming)
    old = committed.join(documents.select("path"), "path", "left_semi")
    a, b = incoming.select("id", F.struct(*fields).alias("new")), committed.select("id", F.struct(*fields).alias("old"))
    both = a.join(b, "id", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    out = both.select("id", F.coalesce("new.path", "old.path").alias("path"), status.alias("status"))
    kept = out.where("status <> 'removed'")
    return kept.unionByName(out.where("status = 'removed'").join(old.select("id"), "id", "left_semi"))


def collisions(incoming: DataFrame, committed: DataFrame) -> DataFrame:
    """Chunks whose id belongs to another document already."""
    other = committed.select("id", F.col("path").alias("committed_path"))
    return incoming.select("id", "path").join(other, "id").where("path <> committed_path")


def checked_input(documents: DataFrame, delete_paths: DataFrame | None = None) -> None:
    """Refuse repeated paths, and paths both written and deleted."""
    if not documents.groupBy("path").count().where("count > 1").isEmpty():
        raise ValidationError("a document is given twice")
    if delete_paths is not None and not documents.select("path").intersect(delete_paths.select("path")).isEmpty():
        raise ValidationError("a document is both written and deleted")


def missing_paths(documents: DataFrame, committed: DataFrame) -> DataFrame:
    """Committed documents that a reconcile no longer finds."""
    return committed.select("path").distinct().join(documents.select("path"), "path", "left_anti")


def counters(classified: DataFrame, documents: DataFrame, committed: DataFrame, delete_paths: DataFrame | None = None) -> DataFrame:
    """One row of run counters.

    ``delete_paths``: explicit deletes; those that don't exist count as unchanged documents.
    """
    spark = documents.sparkSession
    deletes = (spark.createDataFrame([], "path string") if delete_paths is None else delete_paths.select("path")).distinct()
    by_status = classified.groupBy("status").agg(F.count("*").alias("n"))
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0)).cast("long")
    chunks = by_status.agg(n("new", "changed", "unchanged").alias("chunks_seen"), n("new", "changed").alias("chunks_embedded"), n("removed").alias("removed"))
    changed = classified.where("status <> 'unchanged'").agg(F.countDistinct("path").alias("documents_changed"))
    gone = committed.join(deletes, "path", "left_semi").agg(F.countDistinct("path").alias("documents_deleted"), F.count("*").alias("deleted_chunks"))
    size = documents.agg(F.count("*").alias("docs")).crossJoin(deletes.agg(F.count("*").alias("deletes")))
    one = chunks.crossJoin(changed).crossJoin(gone).crossJoin(size)  # each side is one row
    return one.select(
        (F.col("docs") + F.col("deletes")).alias("documents_seen"), "documents_changed",
        (F.col("docs") - F.col("documents_changed") + F.col("deletes") - F.col("documents_deleted")).alias("documents_unchanged"),
        "documents_deleted", "chunks_seen", "chunks_embedded", (F.col("removed") + F.col("deleted_chunks")).alias("chunks_deleted"),
    )


def merge(committed: DataFrame, upserts: DataFrame, delete_ids: DataFrame | None = None, delete_paths: DataFrame | None = None) -> DataFrame:
    """The next snapshot: paths go, ids go, then upserts come in; an upsert wins over a delete."""
    out = committed
    if delete_paths is not None:
        out = out.join(delete_paths.select("path").distinct(), "path", "left_anti")
    gone = upserts.select("id") if delete_ids is None else upserts.select("id").union(delete_ids.select("id"))
    return out.join(gone.distinct(), "id", "left_anti").unionByName(upserts.select(*committed.columns))

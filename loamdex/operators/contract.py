"""What chunks of any strategy have to keep to before they are embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SAFE_INTEGER = 2**53 - 1


def _counts(c: str) -> Column:
    return F.coalesce(F.col(c).between(0, SAFE_INTEGER), F.lit(False))


def checked(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks with ``fault``: the first rule broken (id, path, ordinal, text, hash, headings or source), or null.

    chunks: (id, path, ordinal, text, content_hash, heading_path, source); a chunk
    whose path is no note's breaks path. Offsets are in UTF-16 units; the end may
    not lie behind the note's.
    """
    lengths = notes.select(F.col("path").alias("_path"), T.utf16_length("content").alias("_length"))
    rows = chunks.join(lengths, chunks["path"] == lengths["_path"], "left")
    ends = ("start_offset", "end_offset", "start_line", "end_line")
    whole = F.col("source").isNotNull()
    for name in ends:
        whole &= _counts(f"source.{name}")
    ordered = (F.col("source.start_offset") <= F.col("source.end_offset")) & (F.col("source.end_offset") <= F.col("_length")) & (F.col("source.start_line") <= F.col("source.end_line"))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    fault = (
        F.when(~filled("id"), "id").when(F.col("_path").isNull(), "path").when(~_counts("ordinal"), "ordinal").when(F.col("text").isNull(), "text")
        .when(~filled("content_hash"), "hash").when(F.col("heading_path").isNull() | F.exists("heading_path", lambda h: h.isNull()), "headings").when(~(whole & F.coalesce(ordered, F.lit(False))), "source")
    )
    return rows.withColumn("fault", fault).drop("_path", "_length")


def required(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """The chunks, all of them sound; a fault stops the job and names the rule and the note, not the text."""
    rows = checked(chunks, notes)
    message = F.concat(F.lit("a chunk breaks the rule on "), F.col("fault"), F.lit(": "), F.coalesce("path", F.lit("no path")))
    return rows.where(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))).drop("fault")

"""Rewriting many notes at once: backups, new contents, and a report of what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ERRORS = 20


def rewritten(answers: DataFrame, backup_folder: str, append: bool = False) -> DataFrame:
    """(path, content, backup_path, backup, error): a row per note; a failed one keeps its content and has no backup.

    answers: (path, content, answer, error), as ``providers.completed`` gives them.
    With ``append`` an answer holds flashcards for a section at the end; without a
    card the note has failed.
    """
    cards = T.flashcards("answer")
    error = F.coalesce("error", F.when(F.col("answer").isNull(), "no answer"))
    if append:
        error = F.coalesce(error, F.when(cards == "", "no flashcard was found"))
    good = error.isNull()
    new = T.flashcards_section("content", cards) if append else F.col("answer")
    return answers.select(
        "path", F.when(good, new).otherwise(F.col("content")).alias("content"), F.when(good, F.concat(F.lit(backup_folder.rstrip("/") + "/"), T.basename("path"))).alias("backup_path"),
        F.when(good, F.col("content")).alias("backup"), error.alias("error"),
    )


def backups(rows: DataFrame) -> DataFrame:
    """(path, content) to write before the notes; of notes with one name the first path's is kept."""
    return rows.where("backup_path IS NOT NULL").groupBy(F.col("backup_path").alias("path")).agg(F.min_by("backup", "path").alias("content"))


def report(rows: DataFrame, backup_folder: str) -> DataFrame:
    """(report): how many notes were rewritten and failed, and the first 20 errors in path order."""
    failed = rows.where("error IS NOT NULL").orderBy("path").limit(ERRORS)
    line = F.concat(F.lit("- "), T.basename("path"), F.lit(": "), F.col("error"))
    errors = failed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("errors"))
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    one = counts.crossJoin(errors)  # one row each
    listed = F.when(F.col("failed") > 0, F.concat(F.lit("\n\n## Errors\n"), F.col("errors"))).otherwise("")
    return one.select(F.concat(F.format_string("# Batch report\n\nRewritten: %d\nFailed: %d\nBackups: ", "ok", "failed"), F.lit(backup_folder), listed).alias("report"))

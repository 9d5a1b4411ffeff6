"""Writing notes to files, from the tasks that hold them.

A note's backup is written before the note, and both beside their places first, then
moved there; so a task that dies leaves each note old, or new with its backup. A rerun
keeps a backup that is there and leaves a note that is new already. A note that can't be
written has an error and holds up no other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.shared import checkpointed

WRITTEN = "path string, state string, error string"


def _present(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.File


def _put(files: fs.FileSystem, path: str, content: bytes) -> None:
    """The whole file, or what was there."""
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with files.open_output_stream(beside) as out:
            out.write(content)
        try:
            files.move(beside, path)
        except OSError:
            # file systems that move onto no file; the backup is there by now
            files.delete_file(path)
            files.move(beside, path)
    finally:
        if _present(files, beside):
            files.delete_file(beside)


def _save(files: fs.FileSystem, root: str, row: dict) -> str:
    target, content = f"{root}/{row['path']}", row["content"].encode()
    if _present(files, target):
        with files.open_input_stream(target) as old:
            if old.read() == content:
                return "unchanged"
    if row["backup"] is not None:
        kept = f"{root}/{row['backup_path']}"
        if not _present(files, kept):
            _put(files, kept, row["backup"].encode())
    _put(files, target, content)
    return "written"


def write_notes(rows: DataFrame, root: str) -> DataFrame:
    """(path, state, error): notes (path, content[, backup_path, backup, error]) written below a folder or URI; state: written, unchanged or failed.

    Rows that come with an error, have no content or aren't in canonical paths fail. Runs at once, and once.
    """
    none = F.lit(None).cast("string")
    given = [F.col(c) if c in rows.columns else none.alias(c) for c in ("backup_path", "backup", "error")]
    bad = F.when(~T.valid_path("path") | (F.col("backup").isNotNull() & ~T.valid_path("backup_path")), "a path isn't canonical").when(F.col("content").isNull(), "no content")
    checked = rows.select("path", "content", *given).withColumn("error", F.coalesce("error", bad))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, error = "failed", row["error"]
                if error is None:
                    try:
                        state = _save(files, base.rstrip("/"), row)
                    except Exception as e:  # of this note alone; texts stay out of the report
                        error = type(e).__name__
                out.append((row["path"], state, error))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["path", "state", "error"])

    return checkpointed(checked.mapInArrow(write, WRITTEN))

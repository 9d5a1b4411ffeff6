"""Vaults as a data source: ``spark.read.format("vault")`` for notes, ``readStream`` for their changes.

Register it with ``spark.dataSource.register(VaultSource)``. Options: path (a folder or
URI of any file system pyarrow knows), bytes (about how much one task reads), reconcile (a
stream asks for a reconcile after so many batches; 0, the default: only at its beginning), changes (true
on a stream), filters (true: filters on paths choose the files that are opened; needs
``spark.sql.python.filterPushdown.enabled``). A schema without ``content`` opens none.

The file system's listing gives no deletions: a stream begins with a reconcile, and
another one comes as often as the option says.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

NOTES = "path string, content string, mtime long"
CHANGES = "op string, path string, new_path string, ts timestamp, seq long"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return files, base.rstrip("/")


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path, size, mtime in nanoseconds) of all notes, in order of path."""
    files, base = opened(root)
    found = files.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((x.path[len(base) + 1 :], x.size or 0, x.mtime_ns or 0) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".md"))


class Some(InputPartition):
    """Notes that one task reads."""

    def __init__(self, notes: list[tuple[str, int]]):
        self.notes = notes


class Changed(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class VaultReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType, size: int):
        self.root, self.schema, self.size, self.wanted = root, schema, size, []

    def _takes(self, path: str) -> bool:
        return all(path.startswith(f.value) if isinstance(f, StringStartsWith) else path in f.value if isinstance(f, In) else path == f.value for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, n, at in listed(self.root):
            if self._takes(path):
                if held and size + n > self.size:
                    out.append(Some(held))
                    held, size = [], 0
                held.append((path, at // 1_000_000))
                size += n
        return [*out, Some(held)]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        files, base = opened(self.root)
        names = [f.name for f in self.schema.fields]
        for path, mtime in partition.notes:
            row = {"path": path, "mtime": mtime}
            if "content" in names:
                with files.open_input_stream(f"{base}/{path}") as note:  # one that can't be read fails the whole read
                    row["content"] = note.read().decode()
            kinds = {"path": pa.string(), "content": pa.string(), "mtime": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([row[k]], kinds[k]) for k in names], names=names)


class FilteringReader(VaultReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f


class VaultStream(DataSourceStreamReader):
    """Offsets: up to which modification time changes have been told, and how many batches there have been."""

    def __init__(self, root: str, every: int):
        self.root, self.every, self.now = root, every, None

    def initialOffset(self) -> dict:
        return {"mtime": -1, "batch": 0}

    def latestOffset(self) -> dict:
        found = listed(self.root)
        top = max((at for _, _, at in found), default=0)
        # what is being written in this very moment is left to the next batch
        top = min(top, time.time_ns() - 1_000_000)
        if self.now is None or top > self.now["mtime"]:
            self.now = {"mtime": top, "batch": (self.now or {"batch": 0})["batch"] + 1}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = end if self.now is None else self.now
        first = start["mtime"] < 0
        again = self.every and end["batch"] // self.every > start["batch"] // self.every
        seq = max(0, end["mtime"])
        rows = [("reconcile", None, None, end["mtime"], seq)] if first or again else []
        rows += [("modify", path, None, at, at) for path, _, at in listed(self.root) if start["mtime"] < at <= end["mtime"]]
        return [Changed(rows[i : i + 10_000]) for i in range(0, len(rows), 10_000)] or [Changed([])]

    def read(self, partition: Changed) -> Iterator[pa.RecordBatch]:
        op, path, new, at, seq = zip(*partition.rows) if partition.rows else ((),) * 5
        arrays = [pa.array(op, pa.string()), pa.array(path, pa.string()), pa.array(new, pa.string()), pa.array([x // 1000 for x in at], pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(seq, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["op", "path", "new_path", "ts", "seq"])

    def commit(self, end: dict) -> None: ...


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        # a stream tells changes, and says so by an option, as the source isn't told
        return CHANGES if self.options.get("changes", "false").lower() == "true" else NOTES

    def reader(self, schema: StructType) -> VaultReader:
        kind = FilteringReader if self.options.get("filters", "false").lower() == "true" else VaultReader
        return kind(self.options["path"], schema, int(self.options.get("bytes", 32 << 20)))

    def streamReader(self, schema: StructType) -> VaultStream:
        return VaultStream(self.options["path"], int(self.options.get("reconcile", 0)))

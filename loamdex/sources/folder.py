"""A folder in any file system Spark knows: small files that are replaced at once, and tables behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .store import base_path


class SharedFolder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, base_path(root)
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        here = self._path(self.at(name) if name else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(here)) if self._fs.exists(here) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a small file; whoever reads finds the old text or the new."""
        new = self._path(self.at(f"{name}.tmp"))
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(self.at(name))), options)

    def save(self, rows: DataFrame) -> None:
        """Put a table in place of the one before: it is written whole before the pointer moves, and the old one goes after."""
        before, after = self.read("_TABLE"), f"table={uuid.uuid4().hex}"
        rows.write.parquet(self.at(after))
        self.replace("_TABLE", after)
        for name in self.names():
            if name.startswith("table=") and name not in (after, before):
                self.delete(name)

    def table(self, schema: str) -> DataFrame:
        """The table in force, empty if there is none. The one before stays until the next is saved, for those who still read it."""
        name = self.read("_TABLE")
        return self.spark.createDataFrame([], schema) if name is None else self.spark.read.schema(schema).parquet(self.at(name))

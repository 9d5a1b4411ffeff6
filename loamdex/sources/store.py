"""Vector store of immutable generations.

``root/generation=N`` holds one snapshot as Parquet; ``root/_CURRENT`` names the one in
force with what has to hold for it, and is replaced by an atomic rename after the
new generation has been read back and checked. A crash before the rename leaves
the old state; the generation before is kept for rollback. Readers keep the
generation they began with, so they need no locks.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CompatibilityError, CorruptionError, NotInitializedError, PersistenceError, ValidationError
from ..functions import vectors as V

SCHEMA = "id string, path string, ordinal int, heading_path array<string>, content_hash string, start_offset int, end_offset int, start_line int, end_line int, preview string, vector array<float>"
VERSION, UINT32 = 1, (1 << 32) - 1


@dataclass(frozen=True)
class Manifest:
    generation: int
    dimensions: int
    space: str
    count: int
    schema_version: int = VERSION
    normalized: bool = True


def base_path(root: str) -> str:
    """A clean relative or absolute folder: forward slashes, no empty, ``.`` or ``..`` parts."""
    root = root.replace("\\", "/")
    scheme, sep, rest = root.rpartition("://")
    parts = [p for p in rest.split("/") if p not in ("", ".")]
    if ".." in parts or "\0" in root or not parts:
        raise ValidationError("not a usable store folder")
    return scheme + sep + ("/" if rest.startswith("/") else "") + "/".join(parts)


class NullStore:
    """The store of a disabled index: nothing is kept or found."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def stats(self) -> dict:
        return {"generation": 0, "dimensions": 0, "count": 0, "bytes": 0}

    def commit(self, rows: DataFrame, **_) -> None: ...

    def clear(self) -> None: ...


class GenerationStore:
    def __init__(self, spark: SparkSession, root: str, space: str, dimensions: int):
        self.spark, self.root, self.space, self.dimensions = spark, base_path(root), space, dimensions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def _read_text(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        except Py4JJavaError as e:
            raise CorruptionError("the manifest can't be read") from e
        finally:
            stream.close()

    # reading

    def manifest(self) -> Manifest | None:
        """What _CURRENT says; None if there is no store yet."""
        raw = self._read_text("_CURRENT")
        if raw is None:
            return None
        try:
            m = Manifest(**json.loads(raw))
        except (ValueError, TypeError) as e:
            raise CorruptionError("the manifest can't be read") from e
        if m.schema_version != VERSION or not 0 <= m.generation <= UINT32 or m.count < 0:
            raise CorruptionError("the manifest contradicts itself")
        return m

    def probe(self) -> str:
        """absent, present, incomplete or corrupt, from metadata alone."""
        try:
            m = self.manifest()
        except CorruptionError:
            return "corrupt"
        if m is None:
            return "incomplete" if self._fs.exists(self._at("_CURRENT.tmp")) else "absent"
        return "present" if self._fs.exists(self._at(f"generation={m.generation}")) else "corrupt"

    def _compatible(self) -> Manifest:
        m = self.manifest()
        if m is None:
            raise NotInitializedError("there is no index yet")
        if (m.dimensions, m.space) != (self.dimensions, self.space):
            raise CompatibilityError("the index was built in another embedding space")
        return m

    def read(self) -> DataFrame:
        """The snapshot in force, checked against its manifest."""
        m = self._compatible()
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/generation={m.generation}")
        self._check(rows, m)
        return rows

    def _check(self, rows: DataFrame, m: Manifest) -> None:
        off = F.coalesce(F.max(F.abs(V.l2_norm("vector") - 1)), F.lit(0.0))
        got = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != m.dimensions).alias("odd"), off.alias("off")).first()
        if (got.n, got.ids, got.odd) != (m.count, m.count, 0) or not got.off <= V.UNIT_TOLERANCE:
            raise CorruptionError("the snapshot contradicts its manifest")

    def stats(self) -> dict:
        m = self.manifest()
        if m is None:
            return {"generation": 0, "dimensions": self.dimensions, "count": 0, "bytes": 0}
        return {"generation": m.generation, "dimensions": m.dimensions, "count": m.count, "bytes": self._fs.getContentSummary(self._at(f"generation={m.generation}")).getLength()}

    # writing

    def commit(self, rows: DataFrame, expected: int | None = None, should_commit: Callable[[], bool] = lambda: True) -> Manifest | None:
        """Make rows the next generation. ``expected``: the generation they were derived from; None if should_commit refuses."""
        m = self.manifest()
        now = m.generation if m else 0
        if expected is not None and expected != now:
            raise PersistenceError("the index was changed by another writer")
        if now >= UINT32:
            raise PersistenceError("generations are used up")
        if m is not None:
            self._compatible()
        at = f"{self.root}/generation={now + 1}"
        rows.select(*(f.name for f in self.spark.createDataFrame([], SCHEMA).schema)).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(at)
        back = self.spark.read.schema(SCHEMA).parquet(at)
        new = Manifest(now + 1, self.dimensions, self.space, back.count())
        self._check(back, new)
        if not should_commit():
            self._fs.delete(self._path(at), True)
            return None
        self._point_to(new)
        for old in range(max(0, now - 1), now):  # all but the one before
            self._fs.delete(self._at(f"generation={old}"), True)
        return new

    def _point_to(self, m: Manifest) -> None:
        stream = self._fs.create(self._at("_CURRENT.tmp"), True)
        try:
            stream.write(bytearray((json.dumps(asdict(m), indent=2) + "\n").encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._at("_CURRENT.tmp")), self._fs.makeQualified(self._at("_CURRENT")), options)

    def suspended(self) -> bool:
        """Whether automatic sync is off for this store."""
        return self._fs.exists(self._at("_SUSPENDED"))

    def suspend(self, on: bool) -> None:
        """Turn automatic sync off or on again, for every session that uses the store."""
        at = self._at("_SUSPENDED")
        if on:
            self._fs.create(at, True).close()
        elif self._fs.exists(at) and not self._fs.delete(at, False):
            raise PersistenceError("automatic sync could not be turned on again")

    def clear(self) -> Manifest | None:
        """Commit an empty snapshot."""
        return self.commit(self.spark.createDataFrame([], SCHEMA))

    def reset(self) -> None:
        """Delete what this store wrote, and nothing else."""
        failed = []
        known = ["_CURRENT", "_CURRENT.tmp", "_SUSPENDED"]
        if self._fs.exists(self._path(self.root)):
            known += [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("generation=")]
        for name in known:
            if self._fs.exists(self._at(name)) and not self._fs.delete(self._at(name), True):
                failed.append(name)
        if failed:
            raise PersistenceError(f"could not delete {len(failed)} of the store's files")

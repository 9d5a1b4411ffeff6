"""Incremental substring dedup over a log-structured fingerprint index.

The index holds the runs of windows of all batches so far (see windows.py) in
immutable tables, each sorted by anchor and bucketed by it, so that a new batch,
written as a table of its own, is merge-joined with the older ones without moving
them. A join yields the anchors that repeat, within the batch or against history;
these are verified on the windows themselves. When ``fanout`` tables have gathered,
they are compacted into one before the next batch is filed.

Every word covered by a window that starts anywhere else, in another or the same
document, is removed, in all its places. A window repeats if its run's span does, or if
its own hash does under the same anchor: 64 bits of anchor and 64 bits of span or
window have to agree.

Defined results: null and empty texts, and texts shorter than a window, lose
nothing; rows that repeat are documents of their own, so their windows repeat;
several rows with one doc_id are told apart by their texts; null doc_ids are kept;
very long texts are read whole, by one task each; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows
from .common import checkpoint_folder, checkpointed, dropped, released, written

WINDOW, GRAM, BATCHES, FANOUT = 35, 12, 4, 3
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Codes(dict):
    """Words to 64-bit hashes, remembered; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


def word_coder():
    known = _Codes()

    def codes_of(text: str) -> np.ndarray:
        words = text.encode().split()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return codes_of


class FingerprintIndex:
    """Sorted, bucketed, immutable tables of runs in the shared folder; ``close`` drops them."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []
        self.repeated: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"loamdex_runs_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "anchor").sortWithinPartitions("anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor")
        writer.option("path", self._path(name)).saveAsTable(name)
        return name

    def _path(self, name: str) -> str:
        return f"{checkpoint_folder(self.spark)}/{name}"

    def _drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            dropped(self.spark, self._path(name))
        self.tables = []

    def rows(self) -> DataFrame:
        out = self.spark.table(self.tables[0])
        for name in self.tables[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """File a batch of keyed documents; gives the anchors that it repeats."""
        if len(self.tables) >= self.fanout:
            self.compact()
        name = self._write(windows.file_runs(docs, word_coder, self.window, self.gram))
        new = self.spark.table(name).groupBy("anchor").agg(F.count("*").alias("n"))
        again = new.where("n > 1").select("anchor")
        for old in self.tables:
            again = again.union(new.select("anchor").join(self.spark.table(old).select("anchor"), "anchor", "left_semi"))
        again = checkpointed(again.distinct())
        self.tables.append(name)
        self.repeated.append(again)
        return again

    def compact(self) -> None:
        """Merge all tables into one."""
        merged = self._write(self.rows())
        self._drop()
        self.tables = [merged]

    def repeats(self) -> DataFrame:
        """All filed runs whose anchor occurs more than once."""
        anchors = self.repeated[0]
        for more in self.repeated[1:]:
            anchors = anchors.union(more)
        # written out, so that both sides of the join are plain exchanges and a very common anchor can be split
        return self.rows().join(checkpointed(anchors.distinct()), "anchor")

    def close(self) -> None:
        self._drop()


def repeated_runs(docs: DataFrame, repeats: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, start, n): all runs of windows that occur more than once."""
    least = F.min(F.struct("doc_id", "key", "start", "n")).alias("at")
    # written out for the same reason as anchors are
    spans = checkpointed(repeats.groupBy("anchor", "span").agg(F.count("*").alias("c"), least))
    mixed = checkpointed(spans.groupBy("anchor").agg(F.count("*").alias("spans"), F.min("c").alias("fewest")).where("spans > 1 AND fewest = 1").select("anchor"))
    whole = repeats.join(spans.where("c > 1").select("anchor", "span"), ["anchor", "span"]).select("doc_id", "key", "start", "n")
    looked = spans.join(mixed, "anchor").select("anchor", "c", "at.*")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, codes_of = windows.Powers(), word_coder()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                found = batch.column(3)[i].values
                anchor, c, start, n = (found.field(k).to_numpy() for k in range(4))
                prefix = windows.prefix_hashes(codes_of(batch.column(2)[i].as_py()), powers)
                row = np.repeat(np.arange(len(n)), n)
                at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hashes = windows.stretch_hashes(prefix, at, at + window, powers)
                out.append((anchor[row], hashes.view(np.int64), c[row], np.full(len(row), i), at))
            if out:
                anchor, hashes, c, i, at = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "hash": hashes, "c": c, "doc_id": batch.column(0).take(pa.array(i)), "key": batch.column(1).take(pa.array(i)), "start": at.astype(np.int32)})

    # rows that repeat give their windows repeatedly, which counts for nothing: their runs have c > 1 as it is
    single = written(windows.with_lists(docs, looked, ["anchor", "c", "start", "n"], "inner").mapInArrow(hashed, "anchor long, hash long, c long, doc_id long, key long, start int"))
    released(docs.sparkSession)
    common = checkpointed(single.groupBy("anchor", "hash").agg(F.sum("c").alias("total")).where("total > 1").select("anchor", "hash"))
    parts = single.where("c = 1").join(common, ["anchor", "hash"]).select("doc_id", "key", "start", F.lit(1).alias("n"))
    return whole.unionByName(parts)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row, over all rows filed in batches."""
    docs = windows.keyed(docs)
    index = FingerprintIndex(docs.sparkSession, window, gram)
    try:
        for b in range(batches):
            index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
        repeats = written(index.repeats())
    finally:
        index.close()
    del index
    released(docs.sparkSession)
    found = repeated_runs(docs, repeats, window)
    schema = RESULT + (", kept_text string" if with_text else "")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, found in zip(batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                total = len(words)
                if found.is_valid:
                    gone = windows.covered(total, window, found.values.field(0).to_numpy(), found.values.field(1).to_numpy())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            names = ["n_words", "n_removed", "kept_sha256", "kept_text"]
            if out:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **dict(zip(names, (list(c) for c in zip(*out))))})

    return windows.with_lists(docs, found, ["start", "n"], "left").mapInArrow(cut, schema)

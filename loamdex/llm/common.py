"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task contracts.
PORTION = 1_000_000
#: Words of the contracts: runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it is unset (single-machine tests), one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loamdex-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``checkpointed``, as compressed Parquet: for larger tables, with the folder. The files go when the driver's Python ends, if not before."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/loamdex-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(dropped, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``stored`` without the folder."""
    return stored(df)[0]


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of jobs whose results have been written out.

    It does so when the driver's references to them are collected, which between two
    jobs of one operator would otherwise happen by chance. References go in two steps
    (Python's, then the JVM's), and the cleaner works in the background.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def word_count(text: str | Column) -> Column:
    """Number of words, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) that connect what the given ones do: within each of ``parts`` portions, every node and the least it reaches there."""
    kind = edges.schema["u"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while (y := parent[x]) != x:
                parent[x] = x = parent[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = top(u) if u in parent else parent.setdefault(u, u), top(v) if v in parent else parent.setdefault(v, v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        found = [(x, r) for x in parent if (r := top(x)) != x]
        for at in range(0, len(found), 1 << 16):
            u, v = zip(*found[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.repartition(parts).mapInArrow(joined, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, a: str, b: str, portion: int = PORTION) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's least node. Nodes are longs or strings.

    Portions of bounded size are contracted first, which leaves at most one edge
    per node in each; what is one portion is done with that. Then alternating large-star
    and small-star rounds (Kiveris et al. 2014): every round is two grouped minima
    and joins over an edge set that never grows, so hubs are combined before they
    are shuffled and nothing is collected.
    """
    edges = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen, parts = None, -(-edges.count() // portion)
    if parts:
        edges = checkpointed(contracted(edges, parts))
    while parts > 1:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select("v", "u"))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

"""Centroid clustering: Lloyd's rounds by differences, in whole numbers.

The vectors' owners and distances and the clusters' sums persist between rounds. A
round compares a vector with those centroids alone that changed in the round before; only
if its own centroid was one of them, with all. A centroid that stayed where it was can't have
become nearer than the owner. Vectors that change hands are read again, and each task
adds them up as signed transfers: to the new owner, from the old. The driver has the
sums and centroids, clusters times components of them, and stops when no centroid changes.

Owners are written next to their vectors, so a round reads and writes one table in the
shared folder and shuffles nothing but the tasks' sums; the table before goes then.

Nulls, vectors of another size, and vectors with null or non-finite components take no
part; a null vec_id is written as the empty text in the hash. Empty tables give no rows. Fewer vectors than
clusters make fewer clusters. Ties: the smaller cluster; of equal hashes, the smaller vector first.
Repeated rows are vectors of their own. Components are cut off at 2**27 to either side, which
keeps all distances in 63 bits; sums of distances are cut off at the largest long. Very long texts: there are none. Other columns are dropped
unless named in ``keep``, and named apart, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored
from .vectors import matrix, quantised, usable

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
BOUND = 1 << 27
LONGEST = (1 << 63) - 1


def assigned(rows: DataFrame, centroids: list[list[int]], changed: list[int]) -> DataFrame:
    """rows (v, cluster, distance, ...) with the nearest centroid and what was before in ``was``; those outside ``changed`` stand where they stood."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.array(centroids, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), places.shape[1])
            was, distance = batch.column("cluster").to_numpy(zero_copy_only=False), batch.column("distance").to_numpy(zero_copy_only=False).copy()
            cluster = was.copy()
            lost = (was < 0) | np.isin(was, changed)
            cluster[lost], distance[lost] = len(places), LONGEST
            for mine, rivals in ((np.flatnonzero(lost), range(len(places))), (np.flatnonzero(~lost), changed)):
                part = v[mine]
                for c in rivals:
                    d = ((part - places[c]) ** 2).sum(1)
                    nearer = (d < distance[mine]) | ((d == distance[mine]) & (c < cluster[mine]))
                    cluster[mine[nearer]], distance[mine[nearer]] = c, d[nearer]
            new = {"cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64()), "was": pa.array(was, pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(name)) for name in batch.schema.names], schema=batch.schema)

    return rows.mapInArrow(assign, rows.schema)


def transfers(rows: DataFrame) -> DataFrame:
    """(cluster, i, change): what each cluster's sum gains in component i; i = -1: its count."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths()
            v = np.c_[matrix(batch.column("v"), lengths[0].as_py() if len(lengths) else 0), np.ones(batch.num_rows, np.int64)]
            for name, sign in (("cluster", 1), ("was", -1)):
                owner = batch.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(owner[owner >= 0]).tolist():
                    change[c] = change.get(c, 0) + sign * v[owner == c].sum(0)
        for c, d in change.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(d), pa.int32()), pa.array([*range(len(d) - 1), -1], pa.int32()), pa.array(d, pa.int64())], names=["cluster", "i", "change"])

    return rows.where("cluster <> was").select("v", "cluster", "was").mapInArrow(moved, "cluster int, i int, change long").groupBy("cluster", "i").agg(F.sum("change").alias("change"))


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance, row) of the vectors (vec_id, embedding) that take part, and the centroids; ``row``: the columns in keep."""
    none = F.lit(-1)
    kept = vectors.where((F.size("embedding") == dimensions) & usable("embedding"))
    rows, folder = stored(kept.select("vec_id", quantised("embedding", scale, BOUND).alias("v"), none.alias("cluster"), none.cast("long").alias("distance"), none.alias("was"), F.struct(F.lit(True).alias("_"), *keep).alias("row")))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.v) for r in rows.select(drawn.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()]
    sums = [[0] * dimensions for _ in centroids]
    counts, changed = [0] * len(centroids), list(range(len(centroids)))

    def next_table() -> tuple[DataFrame, str]:
        after = stored(assigned(rows, centroids, changed))
        dropped(rows.sparkSession, folder)
        return after

    for _ in range(rounds):
        if not changed:
            break
        rows, folder = next_table()
        for r in transfers(rows).collect():  # clusters x components
            if r.i < 0:
                counts[r.cluster] += r.change
            else:
                sums[r.cluster][r.i] += r.change
        moved = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids)]
        changed = [c for c, (a, b) in enumerate(zip(centroids, moved)) if a != b]
        centroids = moved
    if changed:
        rows, folder = next_table()
    return rows.drop("was"), centroids


def summed(vectors: DataFrame, **options) -> DataFrame:
    """The clustered vectors with their cluster's and the whole's sum of distances and the digest of their centroid."""
    rows, centroids = clustered(vectors, **options)
    totals = {r.cluster: int(r.n) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # a row for each cluster
    most = lambda n: F.lit(min(n, LONGEST)).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.withColumns({
        "cluster_inertia": of([most(totals.get(c, 0)) for c in range(len(centroids))]).cast("long"), "inertia": most(sum(totals.values())),
        "centroid_sha256": of([F.lit(d) for d in digests]).cast("string"),
    })

"""Exact top-k search: distributed histogram selection.

Every query is scored against all rows, several times over, and no score is kept but the
ones that count. A pass gives each query a histogram of its scores in the range
where its kth highest must be; the histograms are summed over all tasks, the bin of the kth becomes
the next range, until a bin is one score wide or holds no more than are missing. The last pass
passes on what reaches that score, at equal scores the smallest vec_ids.

Tasks pass on only their histogram's top bins, down to their own kth score, as the kth of
all can't be lower, and of the filter's hits k a query. So what is shuffled is k rows a
query and task at most, whatever ties there are. Queries come in waves of bounded size, which
are broadcast one after the other; the table is read a few times for each wave. The work is the
number of queries times the number of rows, as it must be.

Scores are whole numbers: products in floating point are exact while the product of the longest norms, which
bounds every partial sum, fits in the mantissa, else 64-bit integers are used.

Nulls: vectors that are null or hold null or non-finite components take no part; rows
without a vec_id are found, but are no queries, and come last among equals. Empty tables give no rows, empty vectors score 0.
Vectors of unlike sizes are compared as far as both go. Components are cut off at 2**24 to either side.
Repeated rows are found beside their equals: only a query's own row is left out. Very long texts: there are none. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .vectors import matrix, quantised, usable

SCALE, EVERY, TOP, BINS = 256, 50, 5, 512
BOUND = 1 << 24
#: Components of all queries that are broadcast together, and scores that a task holds at once.
WAVE, TOGETHER = 1 << 19, 1 << 21
LAST = (1 << 63) - 1
FOUND = "query long, query_id long, vec_id long, nameless boolean, row long, score long"


class Wave:
    """Queries that are searched together, and where the kth score of each may be."""

    def __init__(self, rows: list, longest: float, top: int, bins: int):
        self.row, self.name = np.array([r.row for r in rows], np.int64), np.array([r.vec_id for r in rows], np.int64)
        self.size, self.top, self.bins = max((len(r.v) for r in rows), default=0), top, bins
        v = np.zeros((len(rows), self.size), np.int64)
        for i, r in enumerate(rows):
            v[i, : len(r.v)] = r.v
        self.bound = math.ceil(math.sqrt(max(int((x.astype(object) ** 2).sum()) for x in v)) * longest) + 2
        self.type = np.float32 if self.bound < 1 << 22 else np.float64 if self.bound < 1 << 51 else np.int64
        self.v = v.astype(self.type)
        self.low = np.full(len(rows), -self.bound, np.int64)
        #: Bits of a score below a bin's; -1: settled, everything from ``low`` on is in question.
        self.shift = np.full(len(rows), max(0, (2 * self.bound // bins).bit_length()), np.int64)
        self.width, self.above = np.full(len(rows), bins, np.int64), np.zeros(len(rows), np.int64)
        self.order = np.argsort(self.row)

    def open(self) -> np.ndarray:
        return np.flatnonzero(self.shift >= 0)

    def narrowed(self, found: list) -> None:
        """The next ranges, from each query's (query, bin, n, above): the bin of its kth score, what is in it and above."""
        seen = {r.query: r for r in found}
        for i in self.open().tolist():
            if (r := seen.get(i)) is None:  # there are fewer than k rows
                self.low[i], self.shift[i] = -self.bound, -1
                continue
            self.low[i] += r.bin << self.shift[i]
            self.above[i] += r.above
            self.width[i] = min(self.bins, 1 << int(self.shift[i]))
            settled = self.shift[i] == 0 or self.above[i] + r.n == self.top
            self.shift[i] = -1 if settled else max(0, self.shift[i] - (self.bins.bit_length() - 1))

    def scored(self, batches: Iterator[pa.RecordBatch], mine: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, tuple]]:
        """Parts of the batches with some of the queries, their scores, and where among these a query meets itself."""
        step = max(1, TOGETHER // (max(1, min(len(mine), TOGETHER >> 11)) + self.size))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v, rows = matrix(part.column("v"), self.size).astype(self.type), part.column("row").to_numpy(zero_copy_only=False)
                spot = self.order[np.minimum(np.searchsorted(self.row, rows, sorter=self.order), len(self.row) - 1)]
                self_at = np.flatnonzero(self.row[spot] == rows)
                for q in range(0, len(mine), TOGETHER >> 11):
                    some = mine[q : q + (TOGETHER >> 11)]
                    place = np.searchsorted(some, spot[self_at])
                    met = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == spot[self_at])
                    yield part, some, self.v[some] @ v.T, (place[met], self_at[met])

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = self.open()
        total = np.zeros((len(mine), self.bins), np.int64)
        for _, some, scores, own in self.scored(batches, mine):
            low, shift = self.low[some][:, None], self.shift[some][:, None]
            # whole numbers and a power of two: the quotient is exact
            spot = (scores - low) >> shift if self.type is np.int64 else np.floor((scores - low) * np.exp2(-shift.astype(np.float64)))
            inside = (spot >= 0) & (spot < self.width[some][:, None])
            inside[own] = False
            flat = (spot + np.arange(len(some))[:, None] * self.bins)[inside].astype(np.int64)
            at = int(np.searchsorted(mine, some[0]))
            total[at : at + len(some)] += np.bincount(flat, minlength=len(some) * self.bins).reshape(len(some), self.bins)
        total = total[:, ::-1]
        # a task's own kth score is no higher than the kth of all
        needed = (total > 0) & (np.cumsum(total, 1) - total < self.top)
        query, spot = np.nonzero(needed)
        yield pa.RecordBatch.from_arrays([pa.array(mine[query], pa.int32()), pa.array(self.bins - 1 - spot, pa.int32()), pa.array(total[query, spot], pa.int64())], names=["query", "bin", "n"])

    def filtered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64) for _ in range(5)]  # query, score, vec_id, nameless, row
        for part, some, scores, own in self.scored(batches, np.arange(len(self.row))):
            reached = scores >= self.low[some][:, None]
            reached[own] = False
            q, c = np.nonzero(reached)
            column = part.column("vec_id")
            name = column.fill_null(LAST).to_numpy(zero_copy_only=False)
            new = (some[q], scores[q, c].astype(np.int64), name[c], column.is_null().to_numpy(zero_copy_only=False)[c].astype(np.int64), part.column("row").to_numpy(zero_copy_only=False)[c])
            best = [np.r_[a, b] for a, b in zip(best, new)]
            order = np.lexsort((best[4], best[2], best[3], -best[1], best[0]))
            best = [x[order] for x in best]
            rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [x[rank < self.top] for x in best]
        query, score, name, nameless, row = best
        yield pa.RecordBatch.from_arrays([pa.array(self.row[query]), pa.array(self.name[query]), pa.array(name), pa.array(nameless.astype(bool)), pa.array(row), pa.array(score)], names=["query", "query_id", "vec_id", "nameless", "row", "score"])


def waves(queries: DataFrame, size: int) -> Iterator[list]:
    """Queries in lists of at most ``size`` components, or single ones."""
    held, components = [], 0
    for r in queries.toLocalIterator():
        if held and components + len(r.v) > size:
            yield held
            held, components = [], 0
        held.append(r)
        components += len(r.v) + 1
    if held:
        yield held


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, scale: int = SCALE, bins: int = BINS, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` highest inner products of the vectors (vec_id, embedding) whose vec_id ``every`` divides, with all others. bins: a power of two."""
    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = written(vectors.where(usable("embedding")).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale, BOUND).alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(norm).alias("n")).first().n or 0.0
    found = None
    for held in waves(rows.where(F.pmod("vec_id", F.lit(every)) == 0), wave):
        w = Wave(held, longest, top, bins)
        while len(w.open()):
            shared = context.broadcast(w)
            counts = rows.select("row", "v").mapInArrow(lambda b, s=shared: s.value.histograms(b), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
            reached = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
            kth = counts.withColumn("reached", reached).withColumn("above", F.col("reached") - F.col("n"))
            # the ranges above a wave's bins are known already: they count as reached
            missing = spark.createDataFrame([(i, int(top - w.above[i])) for i in w.open().tolist()], "query int, missing long")
            w.narrowed(kth.join(F.broadcast(missing), "query").where("reached >= missing AND above < missing").select("query", "bin", "n", "above").collect())  # a row for each query of the wave
            shared.destroy()
        shared = context.broadcast(w)
        some = written(rows.mapInArrow(lambda b, s=shared: s.value.filtered(b), FOUND))
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "nameless", "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("nameless"), F.col("vec_id")).alias("vec_id"), "score")

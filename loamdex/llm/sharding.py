"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents of one text (null counts as empty). Sizes are UTF-8
bytes plus 8. Groups of equal size are interchangeable, so they are counted by
size, and the counts are packed: in decreasing size, as many groups of a size as
fit enter the bin of tightest remaining capacity, found in a balanced tree, before
the next bin is looked at, which is what packing them one by one would do. What
reaches the driver is one row per distinct size, and what it gives back one row
per size and bin touched. Groups find their bin by their rank among those of their
size.

``shards`` bins are filled to an even level (law ``bytes``); with ``capacity``
instead, bins of that size are opened as needed, which minimises their number as
best-fit-decreasing does.

Defined results: null and empty texts are one group of checksum 0; repeated rows
and repeated or null doc_ids each take a slot; a group larger than a bin fills
one alone, however long its texts; equal sizes go by the hash of their text; an
empty table gives no rows; extra columns are ignored unless ``keep`` names them,
which has to differ from the result's own names.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Parts of a shard, or of the groups of one size, that are numbered separately before they are laid end to end.
SLOT_PARTS = 1024
#: Ranks of one size that meet the bins of one row of the plan.
RANKS = 4096


class Tree:
    """A treap of distinct (remaining, bin): a search tree balanced by random priorities."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(1)

    @staticmethod
    def _merged(a, b):
        """Of two trees, all of a before all of b; a node is [key, priority, left, right]."""
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Tree._merged(a[3], b)
            return a
        b[2] = Tree._merged(a, b[2])
        return b

    @staticmethod
    def _parted(node, key):
        """The tree's nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = Tree._parted(node[3], key)
            return node, rest
        rest, node[2] = Tree._parted(node[2], key)
        return rest, node

    def add(self, key: tuple[int, int]) -> None:
        below, rest = self._parted(self.root, key)
        self.root = self._merged(self._merged(below, [key, self.random.random(), None, None]), rest)

    def take_from(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Removes and gives the least entry that isn't below key."""
        below, rest = self._parted(self.root, key)
        if rest is None:
            self.root = below
            return None
        least = rest
        while least[2] is not None:
            least = least[2]
        _, rest = self._parted(rest, (least[0][0], least[0][1] + 1))
        self.root = self._merged(below, rest)
        return least[0]

    def take_last(self) -> tuple[int, int]:
        """Removes and gives the greatest entry."""
        last = self.root
        while last[3] is not None:
            last = last[3]
        self.root, _ = self._parted(self.root, last[0])
        return last[0]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """classes: (size, number of items) with each size once. Gives (size, from, to, bin, each).

    Of the items of a size, those ranked from <= rank < to go to bin, bin + 1, ...,
    ``each`` to one. Items in decreasing size enter the bin of tightest remaining
    capacity that holds them; where none does, a new bin is opened, or, if ``bins``
    are given, the emptiest one overflows.
    """
    free, out, opened = Tree(), [], bins or 0
    for b in range(opened):
        free.add((capacity, b))
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            if found := free.take_from((size, -1)):
                left, b = found
                n = min(count - rank, left // size)
                out.append((size, rank, rank + n, b, n))
                free.add((left - n * size, b))
                rank += n
            elif bins is None:
                each = max(1, capacity // size)
                more = -(-(count - rank) // each)
                out.append((size, rank, count, opened, each))
                last = count - rank - (more - 1) * each
                for b in range(more):
                    free.add((capacity - size * (last if b == more - 1 else each), opened + b))
                opened, rank = opened + more, count
            else:
                left, b = free.take_last()
                out.append((size, rank, rank + 1, b, 1))
                free.add((left - size, b))
                rank += 1
    return out


def level(classes: list[tuple[int, int]], bins: int) -> int:
    """The size to which bins fill evenly, items that outweigh it left alone in theirs."""
    total = sum(size * count for size, count in classes)
    for size, count in sorted(classes, reverse=True):
        while count and bins > 1 and size * bins > total:
            total, bins, count = total - size, bins - 1, count - 1
        if count:
            break
    return max(1, -(-total // bins))


def ranked(groups: DataFrame, name: str) -> DataFrame:
    """groups (group_key, bytes) with ``name``: their rank among those of equal bytes, by parts that no size outgrows."""
    groups = groups.withColumn("part", F.pmod(F.xxhash64("group_key"), F.lit(SLOT_PARTS)).cast("int"))
    counts = groups.groupBy("bytes", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bytes", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("group_key"))
    return groups.withColumn("k", within).join(counts, ["bytes", "part"]).select("group_key", "bytes", (F.col("first") + F.col("k") - 1).cast("long").alias(name))


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, group_key, *keep, shard, slot) for every row of (doc_id, text, *keep), by ``shards`` or ``capacity``."""
    if (shards is None) == (capacity is None):
        raise ValueError("either shards or capacity")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group_key"), *keep)
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()  # one row per distinct size
    classes = list(zip(sizes["bytes"].to_pylist(), sizes["n"].to_pylist()))
    plan = best_fit_decreasing(classes, level(classes, shards) if capacity is None else capacity, shards)
    names = ("of_bytes", "low", "high", "bin", "each")
    plan = docs.sparkSession.createDataFrame(pa.table({n: pa.array([p[i] for p in plan], pa.int64()) for i, n in enumerate(names)}))
    spread = plan.withColumn("of_ranks", F.explode(F.sequence(F.expr(f"low div {RANKS}"), F.expr(f"(high - 1) div {RANKS}"))))
    placed = ranked(groups, "rank").withColumn("ranks", F.expr(f"rank div {RANKS}")).join(spread, (F.col("bytes") == F.col("of_bytes")) & (F.col("ranks") == F.col("of_ranks")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    of_group = placed.select(F.col("group_key").alias("of_key"), F.expr("bin + (rank - low) div each").cast("int").alias("shard"))
    # written out, so that the join's sides are plain exchanges and a group of very many copies can be split
    of_group = checkpointed(of_group)
    return numbered(rows.join(of_group, F.col("group_key") == F.col("of_key")).drop("of_key"))


def numbered(placed: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, without a shard ever meeting in one task."""
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(SLOT_PARTS)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group_key"))
    return placed.withColumn("k", within).join(counts, ["shard", "part"]).withColumn("slot", (F.col("first") + F.col("k") - 1).cast("long")).drop("part", "k", "first")

"""Running sums over one global order, without one task that sees all of it.

The order is cut at values of a bounded sample; sums of the parts are a few rows, whose
own running sums are added to those inside each part. A key with very many rows is
spread over the parts like all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checkpointed

#: Values sampled for each part.
SAMPLE = 20


def parted(rows: DataFrame, key: Column, name: str = "part", parts: int = 0) -> DataFrame:
    """rows with the number of their part of the order by ``key``: about equally many rows in each, equal keys together.

    parts: 0 for as many as shuffle partitions. Reruns over the same rows cut at the same values.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(key.alias("k")).where("k IS NOT NULL")
    some = keyed.orderBy(F.xxhash64("k"), "k").limit(parts * SAMPLE).orderBy("k").collect() if parts > 1 else []
    if not some:
        return rows.withColumn(name, F.lit(0))
    kind = keyed.schema["k"].dataType
    value = lambda k: F.struct(*map(F.lit, k)) if hasattr(k, "asDict") else F.lit(k)
    picked = [some[len(some) * i // parts].k for i in range(1, parts)]
    cuts = F.array(*(value(k) for i, k in enumerate(picked) if i == 0 or k != picked[i - 1])).cast(f"array<{kind.simpleString()}>")
    # binary search: how many cuts don't lie behind the key
    steps = F.array(*(F.lit(1 << b) for b in range(len(picked).bit_length() - 1, -1, -1)))

    def reached(at: Column, step: Column) -> Column:
        return at + F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= key), step).otherwise(0)

    # as a generator: the optimizer must not put the expression in place of the column in filters that it moves below windows
    return rows.withColumn(name, F.explode(F.array(F.aggregate(steps, F.lit(0), reached))))


def running(rows: DataFrame, order: Column, size: Column, name: str = "before", by: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """rows with the sum of ``size`` over the rows before them in the order, of all or of those with the same values in ``by``; equal places in the order have no certain order."""
    # written out once with their parts: sums, places and what is upstream aren't computed again
    rows = checkpointed(parted(rows.withColumns({"_order": order, "_size": size}), F.col("_order"), "_part", parts))
    sums = rows.groupBy(*by, "_part").agg(F.sum("_size").alias("_sum"))
    above = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_part") == F.col("_at"))
    inside = Window.partitionBy(*by, "_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_first") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return rows.join(sums, same).withColumn(name, total).drop("_order", "_size", "_part", "_at", "_first", *(f"_{c}" for c in by))


def text_up_to(rows: DataFrame, order: Column, line: Column, limit: int, mark: str = "") -> DataFrame:
    """(text): lines in order, cut at ``limit`` characters with a mark. Only what lies before the cut meets in one place."""
    lines = rows.select(order.alias("o"), line.alias("line"))
    placed = running(lines, F.col("o"), F.length("line") + 1)
    kept = placed.where(F.col("before") <= limit + 1).select("o", F.substring("line", F.lit(1), (F.lit(limit + 1) - F.col("before")).cast("int")).alias("line"))
    whole = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("s"))
    return whole.select(F.when(F.length("s") > limit, F.concat(F.substring("s", 1, limit), F.lit(mark))).otherwise(F.col("s")).alias("text"))

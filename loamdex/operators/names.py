"""Free names for many new notes at once: base, base-2, base-3, ... as if given out one after the other.

Only names with one stem (a name without numbers at its end) can get in each other's
way. Where all wanted names of a stem are the same, the r-th of them gets the r-th number
that isn't taken: its rank plus the taken numbers with fewer than r free ones below.
Both are running counts, so a name that very many want is spread over tasks. Where a
stem has several wanted names ("a" and "a-2"), who comes first matters: such stems
are folded in order, one stem after the other, each with its names in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.providers import path_key
from .ordered import running
from .shared import checkpointed

NUMBERS = r"(?:-(?:[2-9]|[1-9][0-9]+))+$"


def folded(rows: DataFrame) -> DataFrame:
    """(seq, number) of wanted names (stem, seq, key); rows with a null seq are taken names. Sorted by stem and seq, taken names first."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, taken, tried = None, set(), {}
        for batch in batches:
            given, numbers = [], []
            for i, row in enumerate(batch.select(["stem", "key"]).to_pylist()):
                if row["stem"] != stem:
                    stem, taken, tried = row["stem"], set(), {}
                key = row["key"]
                if not batch.column("wants")[i].as_py():
                    taken.add(key)
                    continue
                n = tried.get(key, 1)
                while (key if n == 1 else f"{key}-{n}") in taken:
                    n += 1
                taken.add(key if n == 1 else f"{key}-{n}")
                tried[key] = n + 1
                given.append(i)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("seq").take(pa.array(given, pa.int64())), pa.array(numbers, pa.int64())], names=["seq", "number"])

    wants = F.col("seq").isNotNull()
    parts = rows.withColumn("wants", wants).repartition("stem").sortWithinPartitions("stem", "wants", "seq")
    return parts.mapInArrow(fold, f"seq {rows.schema['seq'].dataType.simpleString()}, number long")


def free_names(wanted: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """wanted (seq, name, ...) with ``free``: the name, or with the first number from 2 on behind it that makes it free.

    seq: the order in which names are given out, of any type that has one; each only once. taken:
    (name), in any order. Names are compared without case, in composed characters. Null names stay null.
    """
    stem = lambda key: F.regexp_replace(key, NUMBERS, "")
    asked = checkpointed(wanted.where("name IS NOT NULL").select("seq", path_key("name").alias("key")).withColumn("stem", stem("key")))
    order = asked.schema["seq"].dataType.simpleString()
    none = asked.select("key", "stem").limit(0)
    held = none if taken is None else taken.where("name IS NOT NULL").select(path_key("name").alias("key")).withColumn("stem", stem("key")).distinct()
    held = checkpointed(held)
    mixed = asked.groupBy("stem").agg(F.min("key").alias("key"), (F.min("key") != F.max("key")).alias("mixed"))
    alone, several = mixed.where("NOT mixed").select("stem", "key"), mixed.where("mixed").select("stem")
    # one wanted name: ranks against taken numbers
    behind = F.regexp_extract(F.expr("substring(t.key, length(a.key) + 1)"), r"^-([2-9]|[1-9][0-9]{1,17})$", 1)
    number = F.when(F.expr("t.key = a.key"), F.lit(1).cast("long")).when(F.expr("startswith(t.key, a.key)") & (behind != ""), behind.cast("long"))
    numbers = held.alias("t").join(alone.alias("a"), "stem").select("a.key", number.alias("number")).where("number IS NOT NULL")
    numbers = running(numbers, F.col("number"), F.lit(1).cast("long"), by=("key",)).select("key", (F.col("number") - F.col("before") - 1).alias("place"), F.lit(None).cast(order).alias("seq"))
    ranks = running(asked.join(alone.select("stem"), "stem"), F.col("seq"), F.lit(1).cast("long"), by=("key",)).select("key", (F.col("before") + 1).alias("place"), "seq")
    # a taken number counts for ranks beyond the free numbers below it
    both = running(checkpointed(ranks.union(numbers)), F.struct("place", F.col("seq").isNull().alias("later")), F.when(F.col("seq").isNull(), 1).otherwise(0).cast("long"), by=("key",))
    given = both.where("seq IS NOT NULL").select("seq", (F.col("place") + F.col("before")).alias("number"))
    crowd = asked.join(several, "stem", "left_semi").unionByName(held.withColumn("seq", F.lit(None).cast(order)).join(several, "stem", "left_semi"))
    # checkpointed, as a union of parts by stem may pass for being dealt by stem when it isn't any more
    given = given.union(folded(checkpointed(crowd.select("stem", "seq", "key"))))
    new = F.when(F.col("number") > 1, F.concat("name", F.lit("-"), F.col("number").cast("string"))).otherwise(F.col("name"))
    return wanted.join(given.select(F.col("seq").alias("_seq"), "number"), wanted["seq"] == F.col("_seq"), "left").withColumn("free", new).drop("_seq", "number")

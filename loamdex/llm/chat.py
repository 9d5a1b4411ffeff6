"""Multi-party perspective rotation of conversations (DataFrame functions only).

Every participant of a conversation is the assistant once: that speaker's turns
are rendered as ``assistant``, the others' as named users, system turns as
``system``; the mask covers what the model has to say (the assistant's content
and its end marker) and nothing else.

A conversation comes in pages of ``turns_per_page`` turn numbers, and where turn
numbers repeat or are null, a page in parts of so many turns, so that no row ever
holds an unbounded conversation: pages and parts of one perspective, in order,
concatenate to the whole dialogue, and mask offsets count from a part's start.

Defined results: a null role is the participant ``unknown``; a null text is
empty, a very long one is rendered whole; null turn numbers come last, on a page of
their own (page null); equal turn numbers are ordered by role, then text; repeated
rows are rendered repeatedly; a conversation with system turns alone has no
perspective and so no rows. Neither text nor role can forge a marker: ``<|`` in them
becomes ``< |``, and line ends in a role become blanks (``perspective`` has the role
as it is). Empty tables give no rows and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS_PER_PAGE = 256


def rotate(turns: DataFrame, turns_per_page: int = TURNS_PER_PAGE) -> DataFrame:
    """(conv_id, perspective, page, part, n_turns, text, mask array<struct<start,end>>), one row per part of a page and perspective."""

    def plain(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    speaker = F.coalesce("role", F.lit("unknown"))
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), plain(F.coalesce("text", F.lit(""))).alias("said"))
    people = turns.where("speaker != 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    turns = turns.withColumn("page", F.floor(F.col("turn") / turns_per_page))
    nth = F.row_number().over(Window.partitionBy("conv_id", "page").orderBy("turn", "speaker", "said"))
    turns = turns.withColumn("part", F.floor((nth - 1) / turns_per_page))
    pages = turns.groupBy("conv_id", "page", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    whole = pages.join(people.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))

    def rendered(t):
        mine = t["speaker"] == F.col("perspective")
        name = F.translate(plain(t["speaker"]), "\n\r", "  ")
        head = F.when(mine, "assistant").when(t["speaker"] == "system", "system").otherwise(F.concat(F.lit("user name="), name))
        return F.struct(F.concat(F.lit("<|im_start|>"), head, F.lit("\n")).alias("head"), F.concat(t["said"], F.lit("<|im_end|>")).alias("body"), mine.alias("mine"))

    def grown(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(p["mine"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    parts = whole.select("conv_id", "perspective", "page", "part", F.transform("turns", rendered).alias("parts"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return parts.select(
        "conv_id", "perspective", "page", "part", F.size("parts").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("parts", none, grown, lambda acc: acc["mask"]).alias("mask"),
    )

"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source, its documents in seeded order, are one long row cut in
equal blocks of at most ``block`` words. A source's target is so many of its blocks;
the mix has as many seats as all targets have blocks, and they go to the sources by
the highest quotients ``target / (2 k + 1)``. The mix comes in ``shards``: shard s
holds the seats from s to s + 1 shards-ths, so its quota of blocks is an integer per
source and every shard holds every source in proportion. Each shard then draws its
quota, block by block, from the source's seeded permutation of block numbers, going
on where the shard before it stopped and round again after the last block.

Only one row per source reaches the driver. Offsets are running sums within
``BUCKETS`` parts of each source's order, laid end to end, so no source has to
pass through one task.

Defined results: null text has no words and takes none; very long texts span many
blocks; documents that repeat (same id and text) are separate documents,
interchangeable; null is a source of its own, last in order; a source without words
has target 0; an empty table gives no rows; extra columns are ignored unless ``keep``
names them, which has to differ from the result's own names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, word_count, written

WEIGHTS, SHARE, CAP, BLOCK, SEED = (3, 1, 2), 1.5, 2, 32, 20250
#: Shards of the mix.
SHARDS = 16
#: Parts of a source's seeded order: three hexadecimal digits.
BUCKETS = 4096


@dataclass(frozen=True)
class Plan:
    """upto: the blocks that the shards before each one, and all of them at last, draw from the source."""

    source: str | None
    size: int
    target: float
    blocks: int
    upto: tuple[int, ...]
    step: int
    shift: int


def capped_shares(sizes: list[int], weights: list[int], total: float, cap: float = CAP) -> list[float]:
    """Shares of total by weight; none above cap times its size, what is cut off goes to the others by weight."""
    target, left, free = [0.0] * len(sizes), total, {i for i, s in enumerate(sizes) if s}
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / weight > cap * sizes[i]}
        for i in full or free:
            target[i] = float(cap * sizes[i]) if full else left * weights[i] / weight
        if not full:
            break
        left -= sum(target[i] for i in full)
        free -= full
    return target


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the earlier party; none gets more than ``most``.

    The quotient of the last seat is found by bisection instead of handing out
    seats one by one, so a mix of any length costs the same.
    """
    most = most or [seats] * len(votes)
    exact = [Fraction(v) for v in votes]
    seats = min(seats, sum(m for v, m in zip(exact, most) if v))
    if not seats:
        return [0] * len(votes)

    def given(q: Fraction) -> list[int]:
        return [0 if not v else min(m, max(0, math.floor((v / q + 1) / 2))) for v, m in zip(exact, most)]

    low, high = Fraction(min(v for v in exact if v)) / (4 * seats + 4), Fraction(max(exact)) * 2
    while sum(given(low)) < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        mid = mid.limit_denominator(10**18)
        if not low < mid < high:
            break
        low, high = (mid, high) if sum(given(mid)) >= seats else (low, mid)
    out = given(high)
    while (rest := seats - sum(out)) > 0:
        i = max((i for i, v in enumerate(exact) if v and out[i] < most[i]), key=lambda i: (exact[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def shard_quotas(wanted: list[float], most: list[int], shards: int) -> list[list[int]]:
    """Blocks that each shard draws from each source; shard s has the seats from s to s + 1 shards-ths of all."""
    seats = min(round(sum(wanted)), sum(most))
    upto = [sainte_lague(wanted, seats * s // shards, most) for s in range(shards + 1)]
    return [[b - a for a, b in zip(upto[s], upto[s + 1])] for s in range(shards)]


def plan_mix(sources: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, cap=CAP, block=BLOCK, seed=SEED, shards=SHARDS) -> list[Plan]:
    """sources: (name, words), in order of names by code point with null last."""
    sizes = [n for _, n in sources]
    targets = capped_shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    blocks = [-(-n // block) for n in sizes]
    # a target in blocks of the source's own size; blocks are equal but for sources that fill none
    quotas = shard_quotas([t * b / n if n else 0.0 for t, b, n in zip(targets, blocks, sizes)], [int(cap * b) for b in blocks], shards)
    plans = []
    for i, (name, n) in enumerate(sources):
        step = max(1, (seed * 7919 + 104729 * (i + 1)) % (1 << 20))
        while math.gcd(step, max(1, blocks[i])) != 1:
            step += 1
        upto = tuple(accumulate((q[i] for q in quotas), initial=0))
        plans.append(Plan(name, n, targets[i], blocks[i], upto, step, (seed + 31 * i) % max(1, blocks[i])))
    return plans


def spotted(docs: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, spot, *keep) and the key (named, none, bucket): a document's place in its source's seeded order, and that order's part.

    The source's name and whether it is null are keys of their own: one exchange serves windows and plain joins.
    """
    text = F.coalesce("text", F.lit(""))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text))
    return docs.select("doc_id", "source", word_count("text").alias("size"), order.alias("spot"), *keep).withColumns({"named": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "bucket": F.substring("spot", 1, 3)})


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, block=BLOCK, seed=SEED, shards=SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, pieces, taken, copies, *keep).

    ``start``: where the document's words begin in its source's seeded order;
    ``pieces``: its blocks as (block, words, shards), with each shard that draws the
    block; ``taken``: its words in all shards; ``copies``: how often it comes in a mix of
    whole documents, from the same quotas. Texts are read once.
    """
    rows = written(spotted(docs, seed, keep))
    part = ["named", "none", "bucket"]
    cells = checkpointed(rows.groupBy(*part).agg(F.sum("size").alias("words")))
    sizes = cells.groupBy("named", "none").agg(F.sum("words").alias("n")).collect()  # one row per source
    plans = plan_mix([(None if r.none else r.named, r.n) for r in sorted(sizes, key=lambda r: (r.none, r.named))], weights, share, cap, block, seed, shards)
    fields = "named string, none boolean, source_size long, target double, blocks long, upto array<long>, step long, shift long"
    table = docs.sparkSession.createDataFrame([(p.source or "", p.source is None, p.size, p.target, p.blocks, list(p.upto), p.step, p.shift) for p in plans], fields)
    before = Window.partitionBy("named", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("words").over(before), F.lit(0))).join(table, ["named", "none"]).drop("words")
    inner = Window.partitionBy(*part).orderBy("spot", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(cells, part).withColumn("start", F.col("first") + F.col("inside"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    count = F.greatest("blocks", one)
    # equal blocks: the first ``longer`` of them have a word more than the others' ``least``
    least, longer = _div(F.col("source_size"), count), F.col("source_size") % count

    def begins(b):
        return b * least + F.least(b, longer)

    def block_of(word):
        beyond = word - longer * (least + 1)
        return F.when(beyond < 0, _div(word, least + 1)).otherwise(longer + _div(beyond, F.greatest(least, one)))

    def drawn_by(b):
        """The shards that draw block b, once for each time."""
        first = (b * F.col("step") + F.col("shift")) % count
        quota = F.element_at("upto", -1)
        draws = F.when(first < quota, F.sequence(first, quota - 1, count)).otherwise(F.array().cast("array<long>"))
        return F.transform(draws, lambda t: F.size(F.filter("upto", lambda u: u <= t)) - 1)

    def piece(b):
        words = F.least(begins(b + 1), F.col("start") + F.col("size")) - F.greatest(begins(b), F.col("start"))
        return F.struct(b.alias("block"), words.alias("words"), drawn_by(b).alias("shards"))

    last = F.col("start") + F.greatest("size", one) - 1
    rows = rows.withColumn("pieces", F.when(F.col("size") > 0, F.transform(F.sequence(block_of(F.col("start")), block_of(last)), piece)))
    taken = F.coalesce(F.aggregate("pieces", none, lambda a, p: a + p["words"] * F.size(p["shards"])), none)
    # whole documents: the blocks are gone through in order, as documents are in seeded order already, and round again
    # after the last; a document comes with the block of its middle word, so a source ends within half a document and a block of its quota
    quota, middle = F.element_at("upto", -1), F.least(F.col("start") + _div(F.col("size"), F.lit(2)), F.greatest(F.col("source_size") - 1, none))
    copies = (_div(quota, count) + (block_of(middle) < quota % count).cast("long")).cast("long")
    rows = rows.withColumn("taken", taken).withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "start", "pieces", "taken", "copies", *keep)


def _div(a: Column, b: Column) -> Column:
    """Whole part of a / b, both whole numbers."""
    return F.call_function("div", a, b)

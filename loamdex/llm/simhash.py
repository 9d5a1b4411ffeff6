"""SimHash near-dedup by the generalised pigeonhole principle.

If 64 bits are cut in m parts with thresholds t_1..t_m that sum to radius - m + 1,
two fingerprints within the radius differ by at most t_i bits in some part i. So:

1. one count of bit pairs over all distinct fingerprints tells which bits go
   together; correlated bits are grouped in one part;
2. histograms of up to 8 bits (at most 256 counts each, whatever the corpus)
   estimate how many pairs agree up to t bits in each part; dynamic programming
   allots the thresholds, unequal and -1 where a part isn't probed at all, at the
   least estimated cost, and so picks the number of parts too;
3. every fingerprint is filed under its value in each probed part and probes all
   values within the part's threshold; rows of one value meet in one bucket and are
   verified on all 64 bits. A bucket gives back only links that connect something
   new in it (a spanning forest), never all its pairs. A bucket beyond
   ``BUCKET_ROWS`` is cut in blocks and every pair of blocks is a task of its own:
   nothing is capped.

Copies share a fingerprint and are one class from the start. Components follow
from the links by star contraction.

A similarity of 0.8 takes a wide radius, at which 64 bits let strangers through.
With ``wide`` a second fingerprint of 64 bits, from the same hashes mixed anew,
goes along with the first, and a link also has to be within ``wide`` bits of both
together; parts and probes are those of the first. ``verified`` then cuts components
where no exact shingle similarity of 0.8 connects.

Defined results: null and empty texts and texts without words have fingerprint
zero and link like any other; texts shorter than a shingle are one shingle; very long
texts count whole; repeated rows stay; null doc_ids are ignored in a component's
smallest doc_id, which is null only if all its documents have none; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, written
from .windows import mixed

BITS, SHINGLE, RADIUS, SEED = 64, 4, 4, 42
PARTS = (2, 3, 4, 5, 6, 7, 8)
#: Radius of 64 bits and of 128 that together find most pairs of a shingle similarity of 0.8 or more (see README).
NEAR_RADIUS, NEAR_WIDE = 15, 30
#: Microseconds to shuffle a filed row, and to verify a pair.
ROW_COST, PAIR_COST = 1.5, 0.002
#: Rows of a bucket that one task compares at once.
BUCKET_ROWS = 4096
#: Rows up to which buckets are compared all together, and pairs that are compared at once beyond.
SMALL, PAIRS = 24, 1 << 18
#: Shingle sets of a block that one task compares at once.
SET_ROWS = 1024
#: Bit of a filing key from which the part's number is kept.
PART_SHIFT = 40


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.fromiter((hashed(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += bits_of(hashes[at : at + (1 << 16)]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64."""
    return majority(shingle_hashes(text, shingle, seed))


def wide_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int, int]:
    """The fingerprint, and the one of the same hashes mixed anew."""
    hashes = shingle_hashes(text, shingle, seed)
    return majority(hashes), majority(mixed(hashes))


def fingerprints(text: str | Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprint as a signed long with the same 64 bits."""

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return printed(text)


def wide_fingerprints(text: str | Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """struct(fp, more): both fingerprints as signed longs."""

    @F.pandas_udf("fp long, more long")
    def printed(texts: pd.Series) -> pd.DataFrame:
        both = np.array([wide_fingerprint(t, shingle, seed) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"fp": both[:, 0], "more": both[:, 1]})

    return printed(text)


def bits_of(values: np.ndarray) -> np.ndarray:
    """rows x 64 of 0 and 1, from the lowest bit."""
    return np.unpackbits(values.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


@dataclass(frozen=True)
class Layout:
    """parts: the bits of each part; thresholds: bits that may differ in it, -1 if it isn't probed."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def grouped_bits(together: np.ndarray, n: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """Bits in parts of near equal width; each part grows by the bit most correlated with it.

    together: how often each two bits are set at once, over n fingerprints.
    """
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share)))
    close = np.abs(np.divide(together / max(n, 1) - np.outer(share, share), spread, out=np.zeros_like(spread), where=spread > 0))
    np.fill_diagonal(close, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        sums = close[np.ix_(left, left)].max(axis=1)
        group = [left.pop(int(np.argmax(sums)))]
        while len(group) < width:
            group.append(left.pop(int(np.argmax(close[np.ix_(left, group)].sum(axis=1)))))
        out.append(tuple(group))
    return tuple(out)


def sub_blocks(part: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [part[i : i + 8] for i in range(0, len(part), 8)]


def agreement(histograms: list[np.ndarray]) -> np.ndarray:
    """Chance that two fingerprints differ by d bits in a part, taking its sub-blocks as independent."""
    out = np.ones(1)
    for h in histograms:
        p = h / max(h.sum(), 1)
        apart = np.bitwise_count(np.arange(len(p))[:, None] ^ np.arange(len(p))[None, :])
        out = np.convolve(out, np.bincount(apart.ravel(), (p[:, None] * p[None, :]).ravel()))
    return out


def allot(parts: tuple[tuple[int, ...], ...], chances: list[np.ndarray], n: int, radius: int) -> Layout:
    """Thresholds of least cost that sum to radius - parts + 1, by dynamic programming over the parts."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part, chance in zip(parts, chances):
        grown: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                if t < 0:
                    more = 0.0
                else:
                    probes = 1 + sum(comb(len(part), d) for d in range(1, t + 1)) / 2
                    more = n * probes * ROW_COST + n * n / 2 * float(chance[: t + 1].sum()) * PAIR_COST
                at = spent + t
                if at not in grown or cost + more < grown[at][0]:
                    grown[at] = (cost + more, (*chosen, t))
        best = grown
    cost, chosen = best[radius - len(parts) + 1]
    return Layout(parts, chosen, cost)


def plan_layout(classes: DataFrame, radius: int = RADIUS) -> Layout:
    """Bit groups and thresholds from counts over all distinct fingerprints (fp); 4,096 and some 12,000 counts reach the driver."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at : at + (1 << 16)]
                total += (part.T @ part).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"k": np.arange(BITS * BITS), "n": total.ravel()})

    counted = classes.select("fp").mapInArrow(pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    together = np.zeros(BITS * BITS)
    for r in counted:
        together[r.k] = r.n
    together, n = together.reshape(BITS, BITS), max(classes.count(), 1)  # probes cost something even in an empty table
    groups = [grouped_bits(together, n, m) for m in PARTS if m <= radius + 2]
    blocks = sorted({b for parts in groups for p in parts for b in sub_blocks(p)})

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 256), np.int64)
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy())
            for i, block in enumerate(blocks):
                total[i] += np.bincount(bits[:, block] @ (1 << np.arange(len(block))), minlength=256)
        yield pa.RecordBatch.from_pydict({"k": np.arange(total.size), "n": total.ravel()})

    counts = np.zeros(len(blocks) * 256)
    for r in classes.select("fp").mapInArrow(histogram, "k long, n long").where("n > 0").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r.k] = r.n
    of = {b: counts[256 * i : 256 * i + (1 << len(b))] for i, b in enumerate(blocks)}
    layouts = [allot(parts, [agreement([of[b] for b in sub_blocks(p)]) for p in parts], n, radius) for parts in groups]
    return min(layouts, key=lambda x: x.cost)


def filed(classes: DataFrame, layout: Layout, probing: bool = True) -> DataFrame:
    """(key, fp[, more], probe): each fingerprint under its own value and, if ``probing``, all it probes.

    Of two fingerprints that a mask maps onto each other one probe is enough:
    the one from the fingerprint whose bit at the mask's lowest bit is 0.
    """
    todo, names = [], [c for c in ("fp", "more") if c in classes.columns]
    for i, (part, t) in enumerate(zip(layout.parts, layout.thresholds)):
        if t >= 0:
            masks = [c for d in range(1, t + 1) for c in combinations(range(len(part)), d)] if probing else []
            todo.append((i, part, [(c[0], sum(1 << b for b in c)) for c in masks]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key: np.ndarray, prints: list[np.ndarray], probe: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": key, **dict(zip(names, prints)), "probe": np.full(len(key), probe)})

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                prints = [batch.column(k).slice(at, 1 << 14).to_numpy() for k in range(len(names))]
                bits = bits_of(prints[0])
                for i, part, masks in todo:
                    values = bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))
                    yield rows(values | i << PART_SHIFT, prints, False)
                    for low, mask in masks:
                        here = (values >> low) & 1 == 0
                        yield rows((values[here] ^ mask) | i << PART_SHIFT, [p[here] for p in prints], True)

    return classes.select(*names).mapInArrow(keys, "key long, " + "".join(f"{n} long, " for n in names) + "probe boolean")


class Joined:
    """Which of n rows are connected so far; ``label`` is brought up to date by ``settle``."""

    def __init__(self, n: int):
        self.parent, self.label = list(range(n)), np.arange(n)

    def _top(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def links(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Those that connect something new."""
        new, out = self.label[left] != self.label[right], []
        for x, y in zip(left[new].tolist(), right[new].tolist()):
            p, q = self._top(x), self._top(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                out.append((x, y))
        if out:
            label = np.array(self.parent)
            while not np.array_equal(up := label[label], label):
                label = up
            self.label, self.parent = label, label.tolist()
        return out


def forest(group: np.ndarray, prints: list[np.ndarray], probe: np.ndarray, block: np.ndarray, same: np.ndarray, radius: int, wide: int | None = None, small: int = SMALL) -> list[tuple[int, int]]:
    """Row numbers of links within each run of equal ``group``, only those that connect something new there.

    Rows of a group come with those that are filed, not probing, first. In a group
    of two blocks (``same`` false) only rows of different blocks are compared. In
    groups of up to ``small`` rows, row k meets row k + d for d = 1, 2, ..., all k of
    all groups at once; in larger ones, some filed rows meet all rows after them.
    """
    prints, found = [p.view(np.uint64) for p in prints], []
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[begins[1:], len(group)]
    end_of = np.repeat(ends, ends - begins)

    def near(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
        good = same[a] | (block[a] != block[b])
        if wide is not None:
            good &= apart.astype(np.int64) + np.bitwise_count(prints[1][a] ^ prints[1][b]) <= wide
        return good

    joined, d = Joined(len(group)), 1
    live = np.flatnonzero(~probe & np.repeat(ends - begins <= small, ends - begins))
    while len(live := live[live + d < end_of[live]]):
        apart = np.bitwise_count(prints[0][live] ^ prints[0][live + d])
        close = np.flatnonzero(apart <= radius)
        a = live[close]
        close = close[near(a, a + d, apart[close])]
        found += joined.links(live[close], live[close] + d)
        d += 1
    for begin, end in zip(begins.tolist(), ends.tolist()):
        if end - begin > small:
            joined, here, filed_to = Joined(end - begin), prints[0][begin:end], begin + int((~probe[begin:end]).sum())
            at, rows = begin, 1  # the first row alone: it may connect most of the others
            while at < filed_to:
                upto = min(at + rows, filed_to)
                apart = np.bitwise_count(prints[0][at:upto, None] ^ here[at - begin :])
                x, y = np.divmod(np.flatnonzero((apart <= radius).ravel()), apart.shape[1])
                later = y > x
                x, y = x[later], y[later]
                good = near(x + at, y + at, apart[x, y])
                found += [(i + begin, j + begin) for i, j in joined.links(x[good] + at - begin, y[good] + at - begin)]
                at, rows = upto, min(4 * rows, max(1, PAIRS // (end - begin)))
    return found


def node_of(wide: int | None) -> Column:
    """A class's name: its fingerprint, or both in hexadecimal digits."""
    return F.col("fp") if wide is None else F.concat(F.lpad(F.hex("fp"), 16, "0"), F.lpad(F.hex("more"), 16, "0"))


def links(classes: DataFrame, layout: Layout, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, wide: int | None = None) -> DataFrame:
    """(a, b): verified links that connect all that is linked; nodes as ``node_of`` names them."""
    rows, names = filed(classes, layout), [c for c in ("fp", "more") if c in classes.columns]
    # what a bucket costs goes by the rows that are filed in it; these are few beside the probes
    own = filed(classes, layout, probing=False).groupBy("key").agg(F.count("*").alias("n"))
    hot = checkpointed(own.where(F.col("n") > bucket_rows).select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks")))
    zero = F.lit(0)
    if hot.isEmpty():
        rows = rows.select("key", zero.alias("p"), zero.alias("q"), zero.alias("block"), "probe", *names)
    else:
        rows = rows.join(hot, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(*names, "probe"), F.col("blocks")).cast("int"), zero))
        with_all = F.transform(F.sequence(zero, F.coalesce(F.col("blocks") - 1, zero)), lambda c: F.struct(F.least(F.col("block"), c).alias("p"), F.greatest(F.col("block"), c).alias("q")))
        rows = rows.withColumn("pq", F.explode(with_all)).select("key", "pq.p", "pq.q", "block", "probe", *names)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def emit(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            key, p, q, block, probe, *prints = (whole.column(i).to_numpy() for i in range(5 + len(names)))
            change = np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            found = forest(np.cumsum(change), prints, probe.astype(bool), block, p == q, radius, wide)
            if found:
                sides = [[x[list(side)] for x in prints] for side in zip(*found)]
                if wide is not None:
                    sides = [[["%016X%016X" % both for both in zip(*(x.view(np.uint64).tolist() for x in side))]] for side in sides]
                yield pa.RecordBatch.from_arrays([pa.array(side[0]) for side in sides], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            key, p, q = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
            if len(change):  # all but the last bucket is complete
                cut = int(change[-1]) + 1
                yield from emit(pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)]))
                kept = [batch.slice(cut)]
        if kept:
            yield from emit(pa.Table.from_batches(kept))

    node = "long" if wide is None else "string"
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "probe").mapInArrow(verified, f"a {node}, b {node}")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, keep: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS, wide: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id, component, *keep) for each row; component is a class that stands for the component."""
    if wide is None:
        printed = docs.select("doc_id", fingerprints("text", shingle, seed).alias("fp"), *keep)
    else:
        printed = docs.select("doc_id", wide_fingerprints("text", shingle, seed).alias("both"), *keep).select("doc_id", "both.fp", "both.more", *keep)
    prints = checkpointed(printed.withColumn("node", node_of(wide)))
    classes = checkpointed(prints.groupBy(*[c for c in ("node", "fp", "more") if c in prints.columns]).agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes, plan_layout(classes, radius), radius, bucket_rows, wide), "a", "b")
    of_class = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"))
    ids = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    # written out, so that the join's sides are plain exchanges and a class of very many copies can be split
    named = checkpointed(of_class.drop("least").join(ids, "component"))
    return prints.join(named, "node").select("doc_id", "fp", "component_id", "component", *keep)


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Distinct shingles' XXH64, ascending; the shingles are those of the fingerprint, none without words."""
    return np.unique(shingle_hashes(text, shingle, seed).view(np.int64))


def alike(both: Column, a: Column, b: Column) -> Column:
    """Similarity 0.8 or more of sets of sizes a and b that share ``both``, in whole numbers; empty sets are equal."""
    return 9 * both >= 4 * (a + b)


def verified(members: DataFrame, shingle: int = SHINGLE, seed: int = SEED, set_rows: int = SET_ROWS) -> DataFrame:
    """members (component, text, ...) with ``part`` for text: rows of a component are in one part if links of shingle similarity >= 0.8 connect them.

    Equal shingle sets are one class. Every class is compared with its component's
    least, the pivot; where some aren't like it, each of these is compared with all
    classes of the component, in a grid of blocks. So no pair that could connect
    something is left out, and a group of near copies of one text is linear.
    """

    @F.pandas_udf("klass string, shingles array<long>")
    def classed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle, seed) for t in texts]
        return pd.DataFrame({"klass": [hashlib.md5(s.tobytes()).hexdigest() for s in sets], "shingles": sets})

    own = [c for c in members.columns if c not in ("component", "text")]
    node = F.concat_ws(":", F.col("component").cast("string"), "_class.klass")
    rows = written(members.withColumn("_class", classed("text")).select("component", node.alias("node"), "_class.shingles", *own))
    classes = written(rows.groupBy("component", "node").agg(F.first("shingles").alias("shingles")))
    pivots = classes.groupBy("component").agg(F.min("node").alias("pivot"), F.min_by("shingles", "node").alias("_set"), F.count("*").alias("n")).where("n > 1")
    like = alike(F.size(F.array_intersect("shingles", "_set")), F.size("shingles"), F.size("_set"))
    compared = written(classes.join(pivots, "component").select("component", "node", "pivot", "shingles", "n", like.alias("near")))
    far = compared.where("NOT near").groupBy("component").agg(F.count("*").alias("far"))
    grid = compared.join(far, "component")
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / set_rows)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.ceil(n / set_rows).cast("int") - 1)
    as_far = F.when(~F.col("near"), F.transform(every(F.col("n")), lambda j: F.struct(block(F.col("far")).alias("i"), j.alias("j"), F.lit(True).alias("row"))))
    as_any = F.transform(every(F.col("far")), lambda i: F.struct(i.alias("i"), block(F.col("n")).alias("j"), F.lit(False).alias("row")))
    spots = F.explode(F.concat(F.coalesce(as_far, F.array().cast("array<struct<i:int,j:int,row:boolean>>")), as_any))
    placed = grid.withColumn("spot", spots).select("component", "spot.*", "node", F.when(F.col("near"), F.col("pivot")).otherwise(F.col("node")).alias("root"), "shingles")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["row"]], group[~group["row"]]
        roots = {r: r for r in group["root"]}

        def top(x: str) -> str:
            while roots[x] != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        found = []
        sizes = right["shingles"].map(len).to_numpy()
        others = list(zip(right["node"], right["root"], right["shingles"]))
        for x, own_root, mine in zip(left["node"], left["root"], left["shingles"]):
            # 0.8 needs sizes within a factor of 0.8
            for k in np.flatnonzero(5 * np.minimum(len(mine), sizes) >= 4 * np.maximum(len(mine), sizes)).tolist():
                y, root, theirs = others[k]
                if top(own_root) != top(root):
                    spot = np.minimum(np.searchsorted(theirs, mine), max(len(theirs) - 1, 0))
                    both = int((theirs[spot] == mine).sum()) if len(theirs) else 0
                    if 9 * both >= 4 * (len(mine) + len(theirs)):
                        roots[top(own_root)] = top(root)
                        found.append((x, y))
        return pd.DataFrame(found, columns=["a", "b"])

    more = placed.groupBy("component", "i", "j").applyInPandas(linked, "a string, b string")
    edges = compared.where("near AND node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(more)
    roots = connected_components(edges, "a", "b").withColumnRenamed("node", "_node")
    return rows.join(roots, F.col("node") == F.col("_node"), "left").select("component", F.coalesce("root", "node").alias("part"), *own)

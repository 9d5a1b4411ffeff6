"""URL filters by a Bloom filter cascade.

Level 1 is a Bloom filter of the listed keys; level 2 holds the keys of the
corpus's key universe that level 1 lets through although they are not listed;
level 3 the listed keys that level 2 lets through, and so on until no false
positive is left. A key of the universe is listed exactly if the first level that
rejects it is an even one, so membership is exact without a join.

The universe is every (host suffix, path prefix) of every url: all suffixes of
the host at its dots, with every path prefix of a length that some rule's path
has. The first level's false positive rate is set to about ``listed / universe``,
so that every level, and all that reaches the driver, is about as large as the
list and never as the corpus. Long lists are cut by key hash in slices of
``SLICE_KEYS``, each a cascade, a broadcast and a pass over the pages of its own.

Defined results: a null url, or one without ``://``, has an empty host and path,
so no rule fits; empty hosts and paths fit no rule; rules that repeat count once
(rules with the same key but different actions raise ValueError); null keys are not
listed; repeated rows stay; ties cannot
occur, as a page has one key of each length; very long urls are taken whole, with a key for each of the host's dots; empty tables give no rows; columns other than page_id
and url are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SLICE_KEYS = 5_000_000
#: Levels after which a cascade has surely ended; each is a fraction of the one before.
MOST_LEVELS = 64


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """All keys a url offers to the rules, longest first; of equally long ones, the one with more host."""
    if not host:
        return []
    cuts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
    keys = [(len(host) - c + n, len(host) - c, host[c:] + path[:n]) for c in cuts if c < len(host) for n in lengths if n <= len(path)]
    return [k for _, _, k in sorted(keys, reverse=True)]


class Bloom:
    """Bits of a Bloom filter; probes by double hashing of one 128-bit hash."""

    def __init__(self, keys: list[str], rate: float, seed: int):
        self.seed = seed
        self.size = max(64, math.ceil(len(keys) * math.log2(1 / rate) * 1.4427))
        self.hashes = max(1, round(math.log2(1 / rate)))
        bits = np.zeros(self.size, bool)
        for at in range(0, len(keys), 1 << 16):
            bits[self._spots(keys[at : at + (1 << 16)])] = True
        self.bits = np.packbits(bits)

    def _spots(self, keys: list[str]) -> np.ndarray:
        both = [xxhash.xxh3_128_intdigest(k, self.seed) for k in keys]
        a = np.array([x & 0xFFFFFFFFFFFFFFFF for x in both], np.uint64)
        b = np.array([x >> 64 | 1 for x in both], np.uint64)
        return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.size)

    def holds(self, keys: list[str]) -> np.ndarray:
        spots = self._spots(keys).reshape(len(keys), self.hashes)
        return ((self.bits[spots >> np.uint64(3)] >> (7 - (spots & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def cascade_holds(levels: list[Bloom], keys: list[str]) -> np.ndarray:
    """Membership; exact for keys of the universe the cascade was built over."""
    out = np.zeros(len(keys), bool)
    live = np.arange(len(keys))
    for n, level in enumerate(levels):
        if not len(live):
            return out
        passed = level.holds([keys[i] for i in live])
        out[live[~passed]] = n % 2 == 1
        live = live[passed]
    out[live] = len(levels) % 2 == 1
    return out


def universe_of(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """The distinct keys of all urls: (key). Hosts and path heads are made distinct first, so common ones are made into keys once."""
    most = max(lengths, default=0)
    heads = urls.select(host_of("url").alias("host"), F.substring(path_of("url"), 1, most).alias("head")).distinct()

    @F.pandas_udf("array<string>")
    def keys(host: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([keys_of(h, p, lengths) for h, p in zip(host, head)], dtype=object)

    return heads.select(F.explode(keys("host", "head")).alias("key")).distinct()


def build_cascade(listed: list[str], universe: DataFrame, size: int) -> list[Bloom]:
    """Levels for a list of bounded size over a universe of ``size`` keys, of which all listed ones count as members."""
    here, levels = sorted(set(listed)), []
    if not here:
        return []
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * len(here) / max(1, size)))
    context = universe.sparkSession.sparkContext
    while here:
        level = Bloom(here, rate, len(levels))
        levels.append(level)
        if len(levels) > MOST_LEVELS:
            raise RuntimeError("the cascade doesn't end")
        if len(levels) > 1:
            other, here = here, [k for k, p in zip(other, level.holds(other)) if p]
        else:  # false positives among the keys that are not listed
            shared = context.broadcast(level)

            def passing(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    keys = batch["key"].tolist()
                    yield batch[shared.value.holds(keys) if keys else np.zeros(0, bool)]

            # few pass; only they meet the list, as rows
            passed = universe.mapInPandas(passing, "key string")
            there = passed.join(universe.sparkSession.createDataFrame([(k,) for k in here], "key string"), "key", "left_anti")
            other, here = here, sorted(r.key for r in there.toLocalIterator())
        rate = 0.5
    return levels


def _judged(shared, lengths: list[int]):
    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        rule_levels, block_levels = shared.value
        offers = [keys_of(h, p, lengths) for h, p in zip(host, path)]
        distinct = sorted({k for o in offers for k in o})
        member = dict(zip(distinct, cascade_holds(rule_levels, distinct))) if distinct else {}
        fits = [next((k for k in o if member[k]), None) for o in offers]
        named = sorted({k for k in fits if k})
        blocks = dict(zip(named, cascade_holds(block_levels, named))) if named else {}
        return pd.DataFrame({"rule": fits, "verdict": [None if k is None else "block" if blocks[k] else "allow" for k in fits]}, dtype=object)

    return judged


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", slice_keys: int = SLICE_KEYS) -> DataFrame:
    """rules: (action, host, path). Returns (page_id, host, path, rule, verdict)."""
    actions: dict[str, str] = {}
    for action, host, path in rules:
        if actions.setdefault(host + path, action) != action:
            raise ValueError(f"two actions for {host}{path}")
    lengths = sorted({len(path) for _, _, path in rules})
    urls = pages.select("page_id", "url")
    out = urls.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("_best"))
    # read once for its size and once for each slice
    universe = written(universe_of(urls, lengths))
    size = universe.count()
    slices = max(1, -(-len(actions) // slice_keys))
    for s in range(slices):
        keys = [k for k in actions if xxhash.xxh64_intdigest(k, 7) % slices == s]
        rule_levels = build_cascade(keys, universe, size)
        # which listed keys block: a cascade over the listed keys alone
        spark = pages.sparkSession
        block_levels = build_cascade([k for k in keys if actions[k] == "block"], spark.createDataFrame([(k,) for k in keys], "key string"), len(keys))
        shared = spark.sparkContext.broadcast((rule_levels, block_levels))
        # a slice holds at most one rule for each page; the longest of all slices' wins
        here = _judged(shared, lengths)("host", "path")
        won = F.length("_here.rule") > F.coalesce(F.length("_best.rule"), F.lit(-1))
        out = out.withColumn("_here", here).withColumn("_best", F.when(won, F.col("_here")).otherwise(F.col("_best"))).drop("_here")
        if s + 1 < slices:  # a pass for each slice: a worker holds one slice's cascades
            out = written(out)
            shared.destroy()
    return out.select("page_id", "host", "path", "_best.rule", F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 10 consecutive words of a benchmark item (an item of
fewer words is one pattern). Searching a document, a table of shifts, keyed by
the block of the last two words at hand, skips all positions where no pattern
can end; where the shift is zero, the suffix block selects the few patterns that
end so, and these are compared directly, word by word. Patterns of one length
form one searcher, so short items do not shorten the shifts of the others.

The benchmark is a stated set: it is cut in blocks of at most ``BLOCK_BYTES`` of
text (an item larger than that is one alone). The driver holds one block at a time;
each is broadcast and searched for in a pass of its own over all documents, and the
pass's hits are written to the shared folder, by the hash of the text they are in,
before the next one begins. Patterns are places in one array of word numbers,
tables sorted arrays: some 20 bytes for each word of a block besides its vocabulary.

Defined results: null and empty texts have no words and no hits; items without
words have no pattern; items that repeat, or repeat a window, count once per
item_id; a null item_id hits words but is not counted or listed; very long texts
are searched whole; empty tables give no hits or no rows; columns other than
doc_id and text (item_id and text) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: Text of one block of patterns; a block is what one broadcast holds.
BLOCK_BYTES = 4 << 20
#: Words of documents that are searched together.
TOGETHER = 1 << 18
#: Words of the contract, before letters are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Word bytes are digits, letters (A-Z as a-z) and everything beyond ASCII.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))

HITS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Searcher:
    """Wu-Manber over word numbers, for patterns of one length: places in an array of words."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, items: np.ndarray):
        self.length, self.block, self.words = length, min(2, length), words
        self.free = length - self.block + 1
        keys, shifts = np.zeros(0, np.int64), np.zeros(0, np.int16)
        for end in range(length, self.block - 1, -1):  # rising shifts: the first of equal keys is the least
            new = np.setdiff1d(self.keys_at(words, starts + end - self.block), keys)
            keys, shifts = np.r_[keys, new], np.r_[shifts, np.full(len(new), length - end, np.int16)]
            by = np.argsort(keys, kind="stable")
            keys, shifts = keys[by], shifts[by]
        self.keys, self.shifts = keys, shifts
        suffix, prefix = self.keys_at(words, starts + length - self.block), self.keys_at(words, starts)
        by = np.lexsort((prefix, suffix))
        self.suffix, self.prefix, self.starts, self.items = suffix[by], prefix[by], starts[by], items[by]

    def keys_at(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The blocks of words that begin at the places."""
        return numbers[at].astype(np.int64) if self.block == 1 else numbers[at].astype(np.int64) << 32 | numbers[at + 1].astype(np.int64)

    def search(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(start, items) of every occurrence, by rising start."""
        if len(numbers) < self.length or not len(self.keys):
            return
        here = self.keys_at(numbers, np.arange(self.length - self.block, len(numbers) - self.block + 1))
        spot = np.minimum(np.searchsorted(self.keys, here), len(self.keys) - 1)
        shift = np.where(self.keys[spot] == here, self.shifts[spot], self.free).tolist()
        at, ends = 0, []
        while at < len(shift):
            if skip := shift[at]:
                at += skip
            else:
                ends.append(at)
                at += 1
        if not ends:
            return
        low, high = (np.searchsorted(self.suffix, here[ends], side) for side in ("left", "right"))
        heads = self.keys_at(numbers, np.array(ends))
        for start, a, b, head in zip(ends, low.tolist(), high.tolist(), heads.tolist()):
            bucket = self.prefix[a:b]
            places = slice(a + int(np.searchsorted(bucket, head, "left")), a + int(np.searchsorted(bucket, head, "right")))
            if places.start < places.stop:
                same = (self.words[self.starts[places][:, None] + np.arange(self.length)] == numbers[start : start + self.length]).all(axis=1)
                if same.any():
                    yield start, self.items[places][same]


class _Numbers(dict):
    """Numbers of the patterns' words, -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Matcher:
    """All patterns of a block of items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers = _Numbers()
        self.names = [item for item, _ in items]
        texts = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)], np.int32) for _, text in items]
        lengths = np.array([len(t) for t in texts], np.int64)
        words, first = np.concatenate([*texts, np.zeros(0, np.int32)]), np.cumsum(lengths) - lengths
        self.searchers = []
        for size in np.unique(np.minimum(lengths, window)).tolist():
            if size:
                mine = np.flatnonzero(np.minimum(lengths, window) == size)
                n = lengths[mine] - size + 1
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self.searchers.append(Searcher(size, words, np.repeat(first[mine], n) + offset, np.repeat(mine, n)))

    def find(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each text's words, the stretches that are hit and the items that occur."""
        # a word that no pattern has stands between texts
        flat = [w for words in texts for w in (*words, b"")]
        numbers = np.fromiter(map(self.numbers.__getitem__, flat), np.int32, len(flat))
        ends = np.cumsum([len(words) + 1 for words in texts])
        first = np.r_[0, ends[:-1]]
        edges, items = np.zeros(len(numbers) + 1, np.int32), {}
        for s in self.searchers:
            for start, found in s.search(numbers):
                edges[start] += 1
                edges[start + s.length] -= 1
                items.setdefault(int(np.searchsorted(ends, start, "right")), set()).update(found.tolist())
        hit = np.r_[False, np.cumsum(edges[:-1]) > 0]  # the word between texts is never hit
        turns = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for t, (a, b) in zip(np.searchsorted(ends, turns[:, 0], "right").tolist(), turns.tolist()):
            spans[t].append((a - int(first[t]), b - int(first[t])))
        return [(spans[t], sorted({self.names[i] for i in items.get(t, ())} - {None})) for t in range(len(texts))]


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of checked size, one after the other."""
    block: list = []
    size = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").orderBy("item", "text")
    for row in items.toLocalIterator():
        n = len((row.text or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += n
    yield block


def hits(text: Column, block) -> Column:
    """struct(n_words, hits, items) of one block: a broadcast list of (item_id, text)."""
    matchers: dict = {}

    @F.pandas_udf(HITS)
    def found(texts: pd.Series) -> pd.DataFrame:
        matcher = matchers.get(0)
        if matcher is None:
            matcher = matchers[0] = Matcher(block.value)
        counts, rows, held, size = [], [], [], 0
        for t in texts:
            held.append(words_of(t))
            counts.append(len(held[-1]))
            size += counts[-1]
            if size >= TOGETHER:
                rows += matcher.find(held)
                held, size = [], 0
        rows += matcher.find(held) if held else []
        return pd.DataFrame({"n_words": counts, "hits": [[{"start": a, "end": b} for a, b in spans] for spans, _ in rows], "items": [items for _, items in rows]})

    return found(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with ``n_words, n_hit, items`` in the struct column ``_leak``, which replaces one of that name; every other column stays."""
    context = docs.sparkSession.sparkContext
    blocks = blocks_of(benchmark, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        leak = hits(F.col("text"), context.broadcast(block))
        n_hit = F.aggregate("_leak.hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
        return docs.withColumn("_leak", leak).withColumn("_leak", F.struct("_leak.n_words", n_hit.alias("n_hit"), "_leak.items"))
    key, passes = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))), None
    while block is not None:
        shared = context.broadcast(block)
        found = written(docs.select(key.alias("key"), hits(F.col("text"), shared).alias("found")).where("size(found.hits) > 0").select("key", "found.hits", "found.items").distinct())
        shared.destroy()
        passes = found if passes is None else passes.unionByName(found)
        block, more = more, next(blocks, None)
    spans = F.array_sort(F.flatten(F.collect_list("hits")))  # a row per pass and text at most
    # the union of sorted stretches: count of each what lies beyond the furthest end so far
    union = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    found = written(passes.groupBy("key").agg(spans.alias("spans"), items.alias("items")).select(F.col("key").alias("_leak_key"), union.alias("_leak_hit"), F.col("items").alias("_leak_items")))
    leak = F.struct(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.coalesce("_leak_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_leak_items", F.array().cast("array<string>")).alias("items"))
    return docs.join(found, key == F.col("_leak_key"), "left").withColumn("_leak", leak).drop("_leak_key", "_leak_hit", "_leak_items")

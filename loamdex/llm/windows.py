"""Repeated windows of a fixed number of units (words or bytes), found by anchors.

Of the ``window - gram + 1`` grams inside a window, the one of least hash, leftmost
of equal ones, is its anchor: a choice that depends on the window's content
alone, so equal windows have equal anchors at equal places. Consecutive windows
mostly share an anchor; all windows of one anchor occurrence form a run, and the
units that they cover its span. Filing one row per run instead of one per window
cuts what has to be shuffled some tenfold and loses nothing: two equal windows
always meet under their anchor.

A run's row is (anchor, span, key, doc_id, start, n): hash of the gram, hash of
the span, hash of the text, and the first window and number of windows. Under an
anchor, runs of equal span are equal in all windows; only anchors with several
spans need a look at single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "anchor long, span long, key long, doc_id long, start int, n int"
#: Units that are hashed at once; a longer text is one piece.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)])
        return self.up[:n], self.down[:n]


def prefix_hashes(codes: np.ndarray, powers: Powers) -> np.ndarray:
    """Entry i is the sum of code j times base**j over j < i."""
    return np.r_[np.uint64(0), np.cumsum(codes * powers.get(len(codes) + 1)[0][: len(codes)], dtype=np.uint64)]


def stretch_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of units start..end, wherever they stand; the length counts too."""
    down = powers.get(len(prefix))[1]
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def runs(codes: np.ndarray, ends: np.ndarray, window: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, anchor, span, start, n) of all runs in texts laid end to end; ``ends``: where each text ends."""
    n, width = len(codes), window - gram + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 5
    prefix = prefix_hashes(codes, powers)
    down = powers.get(n + 1)[1]
    grams = n - gram + 1
    hashes = mixed((prefix[gram:] - prefix[:grams]) * down[:grams])
    shift = np.uint64(max(1, int(n).bit_length()))
    least = (hashes >> shift << shift) | np.arange(grams, dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    spot = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    whole = text[: len(spot)] == text[window - 1 :]
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (spot[1:] == spot[:-1]))
    start = np.flatnonzero(first)
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    # a run ends where the next begins or whole windows stop
    stop = np.flatnonzero(whole & ~np.r_[whole[1:] & (spot[1:] == spot[:-1]), False]) + 1
    span = stretch_hashes(prefix, start, stop + window - 1, powers)
    begins = np.r_[0, ends[:-1]]
    return text[start], hashes[spot[start]].view(np.int64), span.view(np.int64), start - begins[text[start]], stop - start


def pieces(codes_of, texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts in pieces of about PIECE units: (first text, last text, codes, ends)."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(codes_of(t))
        size += len(held[-1])
        if size >= PIECE or i == len(texts) - 1:
            yield at, i + 1, np.concatenate(held), np.cumsum([len(x) for x in held])
            at, held, size = i + 1, [], 0


def file_runs(docs: DataFrame, coder, window: int, gram: int) -> DataFrame:
    """One row per run of (doc_id, key, text). ``coder()`` is called once in each task and gives text -> codes."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, codes_of = Powers(), coder()
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for a, _, codes, ends in pieces(codes_of, batch.column(2).to_pylist()):
                text, anchor, span, start, n = runs(codes, ends, window, gram, powers)
                if len(text):
                    at = pa.array(text + a)
                    yield pa.RecordBatch.from_pydict({"anchor": anchor, "span": span, "key": keys.take(at), "doc_id": ids.take(at), "start": start.astype(np.int32), "n": n.astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long"), "key", "text").mapInArrow(filed, RUN)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key tells apart rows that share a doc_id; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def with_lists(docs: DataFrame, rows: DataFrame, fields: list[str], how: str) -> DataFrame:
    """Keyed documents with their rows as one array of structs, ``list``."""
    lists = rows.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct(*fields)).alias("list"))
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["d"]) & (docs["key"] == lists["k"]), how).select("doc_id", "key", "text", "list")


def covered(size: int, window: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of ``size`` units are in a window of one of the runs."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + n + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0

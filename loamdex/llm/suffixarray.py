"""Suffix-array dedup of byte strings.

Every byte covered by a string of ``window`` bytes that also starts earlier is
removed; earlier means a smaller doc_id or, within a document, a smaller offset.

1. Texts are reduced to what can repeat: runs of windows are filed under their
   anchors (see windows.py), and runs whose anchor occurs once cannot hold a
   repeated string. Runs of equal span are stored once, with their earliest place;
   the later ones repeat it whole.
2. The remaining spans are dealt to shards by anchor, so that equal strings
   meet; an anchor with more than ``SPLIT`` spans is dealt to several shards.
3. In each shard a suffix array is built by Larsson-Sadakane refinement (prefix
   doubling that sorts only groups not yet told apart), common prefixes of its
   neighbours by Kasai's rule, and neighbours with ``window`` bytes in common form a
   class, of which all but the earliest are removed.
4. Shards that share a split anchor are merged: their sorted windows, dealt out by
   hash, are looked up in each other by binary search.

Defined results: null and empty texts, and texts shorter than a window, lose
nothing; null doc_ids count as smallest; rows that share a doc_id are ordered by
the hash of their text; rows that are equal in both count as one document, of
which each copy is treated alike; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import checkpointed, released, written

WINDOW, GRAM = 100, 24
#: Spans of one anchor in one shard, and bytes for which a suffix array is built at once.
SPLIT, SHARD_BYTES = 4096, 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RUN = "doc_id long, key long, start int, n int"
MERGED = f"w binary, anchor long, salt int, {RUN}"


def byte_coder():
    codes = windows.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def codes_of(text: str) -> np.ndarray:
        return codes[np.frombuffer(text.encode(), np.uint8)]

    return codes_of


def packed(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as one big-endian number; zeros follow the end."""
    out = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        out[:-step] = out[:-step] << np.uint64(8 * step) | out[step:]
    return out[: len(text)]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes at least, equal ones by position; and the place of each."""
    n = len(text)
    keys = packed(text)
    # the last suffixes end within the key; shortest first, they come before equal keys of longer ones
    tail = max(0, n - 7)
    listed = np.r_[np.arange(n - 1, tail - 1, -1), np.arange(tail)]
    order = listed[np.argsort(keys[listed], kind="stable")]
    sorted_keys, lengths = keys[order], np.minimum(n - order, 8)
    begins = np.r_[True, (sorted_keys[1:] != sorted_keys[:-1]) | (lengths[1:] != lengths[:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    told = 8
    while told < depth:
        open_ = ~(begins & np.r_[begins[1:], True])
        at = np.flatnonzero(open_)
        if not len(at):
            break
        here = order[at]
        beyond = here + told
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = rank[here] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        order[at] = here[by]
        both = both[by]
        begins[at] = np.r_[True, both[1:] != both[:-1]]
        rank[order[at]] = np.maximum.accumulate(np.where(begins[at], at, 0))
        told *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Kasai: bytes each listed suffix shares with the one before it in ``order``, up to ``most``.

    ``order`` holds the window suffixes of all spans, span s those at first[s]..first[s]+n[s].
    A suffix shares at least one byte less than the suffix one position earlier
    did, if that one's neighbour, moved on by one, also comes before it. All
    spans take one step at a time.
    """
    size = len(text)
    eight = packed(text)
    place = np.full(size + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    before = np.full(size + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(order), np.int64)
    had, lanes = np.zeros(len(first), np.int64), np.arange(len(first))
    step = 0
    while len(lanes := lanes[n[lanes] > step]):
        i = first[lanes] + step
        other = before[i]
        h = np.zeros(len(lanes), np.int64)
        if step:
            moved = np.where(before[i - 1] >= 0, before[i - 1] + 1, size)
            carried = (place[moved] >= 0) & (place[moved] < place[i])
            h = np.where(carried, np.maximum(had[lanes] - 1, 0), 0)
        live = np.flatnonzero(other >= 0)
        h[other < 0] = 0
        while len(live):
            a, b = i[live] + h[live], other[live] + h[live]
            inside = (a < size) & (b < size)
            differ = np.where(inside, eight[np.minimum(a, size - 1)] ^ eight[np.minimum(b, size - 1)], np.uint64(1 << 63))
            same = differ == 0
            lead = np.zeros(len(live), np.int64)
            rest = ~same & inside
            # leading equal bytes of a difference
            for byte in range(7, 0, -1):
                lead[rest] += (differ[rest] >> np.uint64(8 * byte) == 0)
            h[live] = np.minimum(h[live] + np.where(same, 8, lead), most)
            live = live[same & (h[live] < most)]
        had[lanes] = h
        shared[place[i]] = h
        step += 1
    return shared


def repeated(spans: list[bytes], order_of: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window by window of the spans: (span, offset, whether an earlier one of its class is here).

    ``order_of`` numbers the spans' documents in order, ``start`` is where their first window stands.
    """
    text = np.frombuffer(b"".join(spans), np.uint8)
    lengths = np.array([len(s) for s in spans])
    first = np.cumsum(lengths) - lengths
    order, _ = suffix_array(text, window)
    span_of = np.repeat(np.arange(len(spans)), lengths)
    offset = np.arange(len(text)) - first[span_of]
    order = order[(offset < n[span_of])[order]]
    shared = common_prefixes(text, order, first, n, window)
    span, off = span_of[order], offset[order]
    spot = order_of[span].astype(np.int64) << 32 | (start[span] + off)
    begins = np.flatnonzero(np.r_[True, shared[1:] < window])
    least = np.minimum.reduceat(spot, begins)
    return span, off, spot != np.repeat(least, np.diff(np.r_[begins, len(order)]))


def as_runs(span: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring offsets of a span joined: (span, first offset, number)."""
    by = np.lexsort((off, span))
    span, off = span[by], off[by]
    begins = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (off[1:] != off[:-1] + 1)])
    return span[begins], off[begins], np.diff(np.r_[begins, len(span)])


def document_order(ids: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Numbers that order rows by (doc_id with null first, key)."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    by = np.lexsort((keys, values, known))
    changed = np.r_[False, (keys[by][1:] != keys[by][:-1]) | (values[by][1:] != values[by][:-1]) | (known[by][1:] != known[by][:-1])]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(changed)
    return out


def shard_repeats(spans: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """spans: (anchor, salt, split, doc_id, key, start, n, text), sorted by (anchor, salt) in each partition.

    Rows with w null are removed runs; rows with w are the earliest windows of a split anchor's shard.
    """

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("w", pa.binary()), ("anchor", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            ids, keys = t["doc_id"].combine_chunks(), t["key"].to_numpy()
            start, n, split = t["start"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64), t["split"].to_numpy()
            texts = t["text"].to_pylist()
            span, off, gone = repeated(texts, document_order(ids, keys), start, n, window)
            if gone.any():
                s, o, m = as_runs(span[gone], off[gone])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(s), pa.binary()), pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int32()), ids.take(pa.array(s)), pa.array(keys[s]), pa.array((start[s] + o).astype(np.int32)), pa.array(m.astype(np.int32))], schema=schema)
            share = ~gone & split[span].astype(bool)
            if share.any():
                s, o = span[share], off[share]
                w = [texts[a][b : b + window] for a, b in zip(s.tolist(), o.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(t["anchor"].to_numpy()[s]), pa.array(t["salt"].to_numpy()[s]), ids.take(pa.array(s)), pa.array(keys[s]), pa.array((start[s] + o).astype(np.int32)), pa.array(np.ones(len(s), np.int32))], schema=schema)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lengths = np.cumsum(pa.compute.binary_length(batch.column(7)).to_numpy())
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            if held:
                last = held[-1]
                if last.column(0)[-1].as_py() != anchor[0] or last.column(1)[-1].as_py() != salt[0]:
                    cuts = np.r_[0, cuts]
            done = 0
            for cut in cuts.tolist():
                upto = int(lengths[cut - 1]) if cut else 0
                if size + upto - (int(lengths[done - 1]) if done else 0) >= shard_bytes:
                    if held or cut > done:
                        yield from solve(pa.Table.from_batches([*held, batch.slice(done, cut - done)]))
                    held, size, done = [], 0, cut
            held.append(batch.slice(done))
            size += int(lengths[-1]) - (int(lengths[done - 1]) if done else 0)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return spans.mapInArrow(solved, MERGED)


def merge_shards(classes: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, start, n): the removed runs in the rows of shard_repeats, and windows that another shard has earlier.

    Equal windows are dealt to one partition by their hash; removed runs pass through.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = pa.compute.is_null(batch.column(0))
            yield batch.filter(done).select(["doc_id", "key", "start", "n"])
            if (rest := batch.filter(pa.compute.invert(done))).num_rows:
                held.append(rest)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ids, keys, start = pa.concat_arrays(rows["doc_id"].chunks), rows["key"].to_numpy(), rows["start"].to_numpy()
        anchor, salt = rows["anchor"].to_numpy(), rows["salt"].to_numpy()
        spot = document_order(ids, keys) << 32 | start
        words = np.array(rows["w"].to_pylist(), dtype=f"S{window}")
        gone = np.zeros(len(words), bool)
        begins = np.r_[0, np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1]
        every, earliest = words[:0], np.zeros(0, np.int64)
        for a, b in zip(begins, np.r_[begins[1:], len(words)]):
            if a and anchor[a] != anchor[a - 1]:
                every, earliest = words[:0], np.zeros(0, np.int64)
            run = words[a:b]
            at = np.searchsorted(every, run)  # each shard's windows are in order
            found = np.flatnonzero(at < len(every))
            found = found[every[at[found]] == run[found]]
            old, here = earliest[at[found]], a + found
            gone[here[spot[here] > spot[old]]] = True
            sooner = spot[here] < spot[old]
            gone[old[sooner]] = True
            earliest[at[found[sooner]]] = here[sooner]
            new = np.setdiff1d(np.arange(b - a), found, assume_unique=True)
            every, earliest = np.insert(every, at[new], run[new]), np.insert(earliest, at[new], a + new)
        k = np.flatnonzero(gone)
        yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(k)), "key": keys[k], "start": start[k], "n": np.ones(len(k), np.int32)})

    spot = F.when(F.col("w").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.xxhash64("w"))
    return classes.repartition(spot).sortWithinPartitions("anchor", "salt", "w").mapInArrow(merged, RUN)


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(doc_id, key, start, n): all runs of windows of keyed documents that also start earlier."""
    filed = windows.file_runs(docs, byte_coder, window, gram)
    # written out, so that both sides of each join below are plain exchanges and a very common anchor can be split
    anchors = checkpointed(filed.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    repeats = written(filed.join(anchors, "anchor"))
    del filed, anchors
    released(docs.sparkSession)
    place = F.struct("doc_id", "key", "start")
    spans = checkpointed(repeats.groupBy("anchor", "span").agg(F.min(place).alias("at"), F.first("n").alias("n")))
    counts = checkpointed(spans.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1"))
    later = repeats.join(spans.select("anchor", "span", "at"), ["anchor", "span"]).where(place != F.col("at")).select("doc_id", "key", "start", "n")
    shards = F.ceil(F.col("spans") / split).cast("int")
    looked = spans.join(counts, "anchor").select("anchor", F.pmod("span", shards).cast("int").alias("salt"), (shards > 1).alias("split"), "n", "at.*")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts, raw = [], [], []
            for i in range(batch.num_rows):
                found, text = batch.column(3)[i].values, batch.column(2)[i].as_py().encode()
                parts.append(found)
                row.append(np.full(len(found), i))
                raw += [text[a : a + n + window - 1] for a, n in zip(found.field(3).to_pylist(), found.field(4).to_pylist())]
            if parts:
                found, at = pa.concat_arrays(parts), pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_pydict({"anchor": found.field(0), "salt": found.field(1), "split": found.field(2), "doc_id": batch.column(0).take(at), "key": batch.column(1).take(at), "start": found.field(3), "n": found.field(4), "text": pa.array(raw, pa.binary())})

    cut = windows.with_lists(docs, looked, ["anchor", "salt", "split", "start", "n"], "inner").mapInArrow(texts, f"anchor long, salt int, split boolean, {RUN}, text binary")
    solved = shard_repeats(cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt"), window)
    # only shards of a split anchor give rows with w; all in one plan, so that texts are moved once for this and for the caller
    several = not counts.where(F.col("spans") > split).isEmpty()
    return later.unionByName(merge_shards(solved, window) if several else solved.select("doc_id", "key", "start", "n"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, split: int = SPLIT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row."""
    docs = windows.keyed(docs)
    schema = RESULT + (", kept binary" if with_text else "")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, found in zip(batch.column(2), batch.column(3)):
                raw, total, spans = text.as_py().encode(), 0, 0
                size = len(raw)
                if found.is_valid:
                    gone = windows.covered(size, window, found.values.field(0).to_numpy(), found.values.field(1).to_numpy())
                    total, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((size, total, spans, hashlib.sha256(raw).hexdigest(), *([raw] if with_text else [])))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            if out:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **dict(zip(names, (list(c) for c in zip(*out))))})

    return windows.with_lists(docs, repeated_runs(docs, window, gram, split), ["start", "n"], "left").mapInArrow(cut, schema)

"""SimHash, substring and suffix-array dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from loamdex.llm import simhash, substring, suffixarray, windows
from loamdex.llm.common import connected_components


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    prints = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and root[a] != root[b]:
                old = root[a]
                root = [root[b] if r == old else r for r in root]
    least = {}
    for r, row in zip(root, rows):
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    return Counter((row[0], p, least.get(r)) for row, p, r in zip(rows, prints, root))


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash_components(docs, rows, bucket_rows):
    got = simhash.near_duplicates(docs, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == brute_components(rows)


def test_simhash_layout_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    for v in values[:40].tolist():
        flips = rng.choice(63, rng.integers(1, 6), replace=False)
        values = np.append(values, v ^ sum(1 << int(b) for b in flips))
    classes = spark.createDataFrame([(int(v),) for v in np.unique(values)], "fp long")
    near = lambda a, b: (a ^ b).bit_count() <= 4
    every = sorted(set(values.tolist()))
    layout = simhash.plan_layout(classes)
    assert sum(layout.thresholds) == 4 - len(layout.parts) + 1 and sorted(b for p in layout.parts for b in p) == list(range(64))
    for parts, thresholds in ((layout.parts, layout.thresholds), (simhash.grouped_bits(np.eye(64), 2, 3), (1, 1, 0)), (simhash.grouped_bits(np.eye(64), 2, 4), (2, 0, 0, -1))):
        found = {tuple(sorted((r.a, r.b))) for r in simhash.links(classes, simhash.Layout(parts, thresholds, 0)).collect()}
        assert all(near(a, b) for a, b in found)
        root = {v: v for v in every}

        def top(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in found:
            root[top(a)] = top(b)
        assert all(top(a) == top(b) for a in every for b in every if near(a, b))


@pytest.mark.parametrize("wide", [None, 26])
def test_forest_connects_what_all_pairs_do(wide):
    rng = np.random.default_rng(4)
    n = 600
    base = rng.integers(0, 1 << 62, (6, 2), dtype=np.int64)[rng.integers(0, 6, n)]
    flips = np.bitwise_or.reduce(np.where(rng.random((n, 2, 4)) < 0.7, np.int64(1) << rng.integers(0, 62, (n, 2, 4)), 0), axis=2)
    prints = [np.ascontiguousarray(c) for c in (base ^ flips).T]
    group = np.sort(np.r_[rng.integers(0, 40, 200), np.full(n - 200, 41)])
    probe, block = rng.random(n) < 0.5, rng.integers(0, 3, n)
    by = np.lexsort((probe, group))
    probe, same = probe[by], (group % 2 == 0) | (group == 41)

    def labels(pairs):
        root = list(range(n))
        for a, b in pairs:
            if root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
        return [root.index(r) for r in root]

    def linked(a, b):
        apart = [(int(p[a]) ^ int(p[b])).bit_count() for p in prints]
        return group[a] == group[b] and not (probe[a] and probe[b]) and (same[a] or block[a] != block[b]) and apart[0] <= 8 and (wide is None or sum(apart) <= wide)

    found = [simhash.forest(group, prints, probe, block, same, 8, wide, small) for small in (24, 0, 1000)]
    want = labels([(a, b) for a in range(n) for b in range(a) if linked(a, b)])
    assert all(labels(pairs) == want and all(linked(a, b) for a, b in pairs) for pairs in found)


@pytest.mark.parametrize("portion", [1_000_000, 40])
def test_components(spark, portion):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(500 + i, 501 + i) for i in range(50)]
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame([(str(1000 + a), str(1000 + b)) for a, b in pairs], "a string, b string"), "a", "b", portion).collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {int(r.node) - 1000: int(r.root) - 1000 for r in got} == {x: root[x] for x in linked} and len(got) == len(linked)


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).collect() == []


def brute_words(rows, size):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(b" ".join(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = Counter()
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[b" ".join(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out[r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("size", "gram", "batches"), [(35, 12, 3), (5, 3, 5)])
def test_substring(docs, rows, size, gram, batches):
    got = substring.remove_repeats(docs, size, gram, batches).collect()
    assert Counter(map(tuple, got)) == brute_words(rows, size)


def test_substring_text_and_tables(spark, docs, none):
    got = substring.remove_repeats(docs.where("doc_id = 9"), with_text=True).first()
    assert hashlib.sha256(got.kept_text.encode()).hexdigest() == got.kept_sha256
    assert substring.remove_repeats(none).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loamdex_runs_")]


def brute_bytes(rows, size):
    """Rows equal in id and text are one document, treated alike."""
    keyed = {(r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)): r for r in rows}
    seen, verdict = set(), {}
    for key in sorted(keyed):
        raw = (keyed[key][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = True
            seen.add(raw[i : i + size])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        verdict[keyed[key][0], keyed[key][1]] = (len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest())
    return Counter((r[0], *verdict[r[0], r[1]]) for r in rows)


@pytest.mark.parametrize(("size", "gram", "split"), [(100, 24, 4096), (100, 24, 2), (20, 8, 3)])
def test_suffix_array_dedup(docs, rows, size, gram, split):
    got = suffixarray.remove_repeats(docs, size, gram, split).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, size)


def test_suffix_array_empty(none):
    assert suffixarray.remove_repeats(none).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=9, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(4, 9))
def test_suffix_array_and_prefixes(spans, window):
    text = np.frombuffer(b"".join(spans), np.uint8)
    order, place = suffixarray.suffix_array(text, 16)
    raw = text.tobytes()
    assert [raw[i : i + 16] for i in order] == sorted(raw[i : i + 16] for i in range(len(raw)))
    lengths = np.array([len(s) for s in spans])
    n, first = lengths - window + 1, np.cumsum(lengths) - lengths
    inside = np.zeros(len(raw), bool)
    for f, m in zip(first, n):
        inside[f : f + m] = True
    some = order[inside[order]]
    shared = suffixarray.common_prefixes(text, some, first, n, window)
    for k in range(1, len(some)):
        a, b = raw[some[k - 1] :][:window], raw[some[k] :][:window]
        same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert shared[k] == same
    span, off, gone = suffixarray.repeated(list(spans), np.arange(len(spans)), np.zeros(len(spans), np.int64), n, window)
    met, want = set(), set()
    for s, text_ in enumerate(spans):
        for o in range(n[s]):
            want |= {(s, o)} if text_[o : o + window] in met else set()
            met.add(text_[o : o + window])
    assert {(s, o) for s, o, g in zip(span.tolist(), off.tolist(), gone) if g} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6), st.integers(2, 4), st.integers(0, 6))
def test_runs_cover_all_windows(texts, gram, more):
    window = gram + more
    codes = [windows.mixed(np.array(t, np.uint64)) if t else np.zeros(0, np.uint64) for t in texts]
    text, anchor, span, start, n = windows.runs(np.concatenate(codes), np.cumsum([len(c) for c in codes]), window, gram, windows.Powers())
    got = sorted((t, s + i) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(k))
    assert got == [(t, i) for t, c in enumerate(texts) for i in range(len(c) - window + 1)]
    by_content = {}
    for t, a, s, k in zip(text.tolist(), anchor.tolist(), start.tolist(), n.tolist()):
        for i in range(s, s + k):
            assert by_content.setdefault(tuple(texts[t][i : i + window]), a) == a

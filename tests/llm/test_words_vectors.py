"""Spelling variants, centroid clustering and top-k search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from loamdex.llm import lloyd, topk, variants
from loamdex.llm.vectors import quantised, usable
from pyspark.sql import functions as F

# spelling variants


def brute_words(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words):
    near = {w: [v for v in words if v != w and one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def variant_rows():
    rng, rows = random.Random(3), []
    stems = ["banane", "überaus", "kitten", "sitting", "aaaaaa", "ÿÿÿÿÿÿ", "lengthening", "m" * 40]
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(("", "a", "b", "ß", w[at] + "b")) + w[at + 1 :]
            words.append(rng.choice((w, w.upper() if w.isascii() else w)))
        rows.append((i, rng.choice((" ", "-", "ǅ", "Ā", "1")).join(words)))
    return rows + [(None, rows[0][1]), (None, None), (7, None), (8, ""), (1, rows[1][1]), (9, "wörter " * 5000)]


@pytest.mark.parametrize("long", [4, 6, 11, variants.LONG])
def test_forms_are_brute_force(spark, long):
    rows = variant_rows()
    words = brute_words(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in variants.spelling_variants(docs, long).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == brute_forms(words) and any(r[3] and r[5] != r[3] for r in got)


def test_words_of_the_corpus(docs, rows, none):
    assert {r.word: r.n for r in variants.counted(docs).collect() if r.n >= 3} == brute_words(rows)
    assert variants.spelling_variants(none).count() == 0


def test_very_long_words(spark):
    a = "".join(random.Random(1).choices("abcdeé", k=20_000))
    words = [a, a[:7000] + "z" + a[7001:], a[:9000] + a[9001:], a[:-1], a[:5000] + "zz" + a[5002:]]
    text = " ".join([words[0]] * 9 + [w for w in words[1:] for _ in range(3)])
    doc_id = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in words))
    got = {r.word: (r.n_near, r.form == a) for r in variants.spelling_variants(spark.createDataFrame([(doc_id, text)], "doc_id long, text string")).collect()}
    assert got == {words[0]: (3, False), words[1]: (1, True), words[2]: (1, True), words[3]: (1, True), words[4]: (0, False)}


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 1)
    total = {}
    variants.count_words(total, "5", "Straße STRASSE straße ab abcd ÀÉÎÕÜ a×bcd÷e")
    assert total == {"straße".encode(): 2, b"strasse": 1, "ÀÉÎÕÜ".encode(): 1, "a×bcd÷e".encode(): 1}


# vectors


def vectors(spark, n=300, seed=1, size=64):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 3) for _ in range(size)]) for i in range(n)]
    at = lambda i: rows[i % n]
    rows += [at(5), at(5), (6, at(7)[1]), (None, at(9)[1]), (None, at(10)[1])]
    rows += [(500, None), (550, [None] * size), (600, [float("nan")] * size), (650, [float("inf")] * size), (700, rows[0][1][:-1]), (750, []), (800, [1e30] + [0.0] * (size - 1))]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("row", F.lit("clash")).repartition(4)


def whole(rows, scale, bound, size=None):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and (size is None or len(v) == size)]
    return [(i, [max(-bound, min(bound, math.floor(scale * x))) for x in v]) for i, v in good]


def brute_lloyd(rows, clusters=8, rounds=10):
    kept = whole(rows, 1024, 1 << 27, 64)
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    places = [v for _, v in start[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    owners = lambda: [min((far(v, p), c) for c, p in enumerate(places)) for _, v in kept]
    for _ in range(rounds):
        near = owners()
        for c in range(len(places)):
            mine = [v for (_, v), (_, k) in zip(kept, near) if k == c]
            if mine:
                places[c] = [sum(x) // len(mine) for x in zip(*mine)]
    near = owners()
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, near)), key=key)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize(("n", "clusters", "rounds"), [(300, 8, 10), (40, 3, 2), (4, 8, 10)])
def test_clusters_are_lloyds(spark, n, clusters, rounds):
    rows, df = vectors(spark, n)
    got = lloyd.summed(df, clusters=clusters, rounds=rounds).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: tuple((x is None, x) for x in r)) == brute_lloyd(rows, clusters, rounds)


def test_only_changed_centroids_are_compared(spark):
    """A centroid outside ``changed`` gains no vector, even if it is nearer."""
    rows = spark.createDataFrame([([0, 0], 1, 50, 1), ([9, 9], 1, 2, 1), ([5, 5], 2, 8, 2), ([0, 0], -1, -1, -1)], "v array<int>, cluster int, distance long, was int")
    got = [(r.cluster, r.distance, r.was) for r in lloyd.assigned(rows, [[0, 0], [8, 8], [5, 6]], [2]).collect()]
    assert got == [(1, 50, 1), (1, 2, 1), (2, 1, 2), (0, 0, -1)]
    changes = {(r.cluster, r.i): r.change for r in lloyd.transfers(lloyd.assigned(rows, [[0, 0], [8, 8], [5, 6]], [1, 2])).collect()}
    assert changes == {(0, 0): 0, (0, 1): 0, (0, -1): 2, (1, 0): 0, (1, 1): 0, (1, -1): -1}


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lloyd.summed(none).count() == 0 and topk.nearest(none).count() == 0
    other = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert lloyd.summed(other).count() == 0 and topk.nearest(other, every=1).count() == 0


def test_components_are_floored(spark):
    df = spark.createDataFrame([([-0.001, 0.0, 1.5, 1e30, -1e30],)], "embedding array<float>")
    assert df.select(quantised("embedding", 256, 1 << 24).alias("v"), usable("embedding").alias("ok")).first() == ([-1, 0, 384, 1 << 24, -(1 << 24)], True)


def brute_topk(rows, top, every, scale=256):
    kept, out = whole(rows, scale, 1 << 24), []
    for q, (name, v) in enumerate(kept):
        if name is not None and name % every == 0:
            scores = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, c) for c, (i, w) in enumerate(kept) if c != q]
            out += [(name, k + 1, None if nameless else i, -s) for k, (s, nameless, i, _) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "every", "bins", "wave"), [(5, 50, 512, topk.WAVE), (5, 5, 2, 700), (1, 10, 16, topk.WAVE), (400, 100, 4, topk.WAVE)])
def test_topk_is_brute_force(spark, top, every, bins, wave):
    rows, df = vectors(spark)
    got = [tuple(r) for r in topk.nearest(df, top, every, bins=bins, wave=wave).collect()]
    assert sorted(got, key=str) == brute_topk(rows, top, every)


@pytest.mark.parametrize("scale", [1, 20_000, 10_000_000])
def test_scores_are_exact_and_ties_bounded(spark, scale):
    """Single, double and 64-bit products; thousands of equal rows pass on a few."""
    rows = [(i, [0.5, 1.0, -1.0]) for i in range(0, 3000)] + [(i, [random.Random(i).uniform(-1, 1) for _ in range(3)]) for i in range(3000, 3100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.nearest(df, 5, 1000, scale=scale).collect()]
    assert sorted(got, key=str) == brute_topk(rows, 5, 1000, scale)

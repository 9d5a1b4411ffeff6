"""Mixing, media, sharding, decontamination, URL filters, chat and toxicity."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loamdex.llm import chat, decontam, media, mixing, sharding, toxicity, urlfilter

# mixing


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 40))
def test_sainte_lague_is_highest_quotients(votes, seats):
    want, got = [0] * len(votes), mixing.sainte_lague([float(v) for v in votes], seats)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert sum(got) == sum(want) and sorted(v / (2 * g + 1) for v, g in zip(votes, got)) == pytest.approx(sorted(v / (2 * w + 1) for v, w in zip(votes, want)))


def test_targets_are_capped_and_shared():
    targets = mixing.capped_shares([100, 1000, 0, 50], [3, 1, 2, 3], 1500.0)
    assert targets == [200.0, 1200.0, 0.0, 100.0]


def brute_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), {s for s in names if sizes[s]}, dict.fromkeys(names, 0.0)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return sizes, target


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes, target = brute_mix(rows)
    assert len(got) == len(rows)
    by_source = defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        by_source[r.source].append(r)
    plans = {p.source: p for p in mixing.plan_mix([(s, sizes[s]) for s in sorted(sizes, key=lambda s: (s is None, s or ""))])}
    for source, found in by_source.items():
        assert abs(sum(r.taken for r in found) - target[source]) <= 2 * min(mixing.BLOCK, sizes[source])
        found.sort(key=lambda r: (r.start, r.size))
        assert [r.start for r in found] == np.r_[0, np.cumsum([r.size for r in found])[:-1]].tolist()  # laid end to end
        drawn = {}
        for r in found:
            assert sum(p.words for p in r.pieces or []) == r.size
            for p in r.pieces or []:
                assert drawn.setdefault(p.block, p.shards) == p.shards
        # every shard draws its quota, and shards draw on along the seeded order
        plan = plans[source]
        assert sorted(drawn) == list(range(plan.blocks))
        quotas = Counter(s for shards in drawn.values() for s in shards)
        assert [quotas[s] for s in range(mixing.SHARDS)] == np.diff(plan.upto).tolist()
        turn = lambda b: (b * plan.step + plan.shift) % plan.blocks
        want = defaultdict(list)
        for s in range(mixing.SHARDS):
            for t in range(plan.upto[s], plan.upto[s + 1]):
                want[t % plan.blocks].append(s)
        assert all(shards == want[turn(b)] for b, shards in drawn.items())
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(none).collect() == []


def test_shard_quotas_hold_every_source():
    plans = mixing.plan_mix([("a", 6400), ("b", 6400), (None, 3200)], shards=5)
    for p in plans:
        assert all(abs(x - p.upto[-1] / 5) <= 1 for x in np.diff(p.upto))
        assert abs(p.upto[-1] * p.size / p.blocks - p.target) <= mixing.BLOCK


def test_small_sources_reach_their_targets(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "s"), (2, "w " * 5000, "t"), (3, "", "u"), (4, "one", "v")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[1].target == got[1].taken == 16 and got[4].target == got[4].taken == 2 and got[3].taken == 0
    assert abs(got[2].taken - got[2].target) <= mixing.BLOCK


# media


@settings(deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([1, 3]), st.integers(0, 9))
def test_images_round_trip(height, width, channels, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (height, width) if channels == 1 else (height, width, 3), dtype=np.uint8)
    assert np.array_equal(media.decode(media.write_netpbm(pixels)), pixels)
    assert np.array_equal(media.decode(media.write_bmp(pixels)), pixels)
    small = media.area_resize(pixels, 3, 2)
    big = np.kron(pixels.astype(float), np.ones((3, 2) if channels == 1 else (3, 2, 1)))  # every pixel as 3 x 2
    means = big.reshape(3, height, 2, width, *pixels.shape[2:]).mean(axis=(1, 3))
    assert np.allclose(small, means, atol=1e-5)
    with pytest.raises(ValueError):
        media.decode(media.write_netpbm(pixels)[:-1])


def test_resize_in_bands(monkeypatch):
    pixels = np.random.default_rng(1).integers(0, 256, (100, 24), dtype=np.uint8)
    whole = media.area_resize(pixels, 8, 9)
    monkeypatch.setattr(media, "BAND", 7)
    assert np.allclose(media.area_resize(pixels, 8, 9), whole, atol=1e-5)


def test_stored_texts(docs, rows, none):
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    got = media.store_texts(docs, with_media=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got[:20]:
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert np.load(BytesIO(r.tile)).shape == (8, 9)
    assert media.store_texts(none).collect() == []


def test_described_images(spark):
    pixels = np.arange(200, dtype=np.uint8).reshape(10, 20)
    images = spark.createDataFrame([(1, bytearray(media.write_bmp(pixels))), (2, None), (3, bytearray(media.write_netpbm(pixels)))], "id int, image binary")
    got = {r.id: r.media for r in media.describe_images(images).collect()}
    assert got[1].feature == got[3].feature == "0" * 16 and got[2].feature is None and (got[1].height, got[1].width) == (10, 20)


# sharding


@given(st.lists(st.integers(1, 60), max_size=40), st.one_of(st.none(), st.integers(1, 5)))
def test_best_fit_decreasing(sizes, bins):
    capacity = 60 if bins is None else max(1, -(-sum(sizes) // bins))
    where, ranks = [0] * len(sizes), defaultdict(list)
    for i, n in enumerate(sizes):
        ranks[n].append(i)
    plan = sharding.best_fit_decreasing(list(Counter(sizes).items()), capacity, bins)
    for size, low, high, first, each in plan:
        for rank in range(low, high):
            where[ranks[size][rank]] = first + (rank - low) // each
    assert sum(high - low for _, low, high, _, _ in plan) == len(sizes)
    free = [] if bins is None else [capacity] * bins
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b, f in enumerate(free) if f >= sizes[i]]
        if fits:
            assert free[where[i]] == min(free[b] for b in fits)
        elif bins is None:
            assert where[i] == len(free)
            free.append(capacity)
        else:
            assert free[where[i]] == max(free)
        free[where[i]] -= sizes[i]


def test_shards(docs, rows, none):
    got = sharding.shard(docs, 6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    by_shard, groups, bytes_of = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        by_shard[r.shard].append(r.slot)
        groups[bytes(r.group_key)].add(r.shard)
        bytes_of[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and all(len(s) == 1 for s in groups.values())
    # one text outweighs a shard; the others share evenly
    heavy = max(bytes_of, key=bytes_of.get)
    rest = [n for s, n in bytes_of.items() if s != heavy]
    assert max(rest) - min(rest) <= max(len((r[1] or "").encode()) for r in rows if len(r[1] or "") < 50_000) + 8
    assert sharding.shard(none, 6).collect() == []
    for cramped in (4096, 1):
        opened = defaultdict(Counter)
        for r in sharding.shard(docs, capacity=cramped).collect():
            opened[r.shard][bytes(r.group_key)] += r.size
        assert sorted(opened) == list(range(len(opened)))
        assert all(sum(n.values()) <= cramped or len(n) == 1 for n in opened.values())


def test_shards_of_many_equal_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKS", 16)
    docs = spark.createDataFrame([(i, f"{i:06d}") for i in range(2000)], "doc_id long, text string")
    got = Counter(r.shard for r in sharding.shard(docs, 7).collect())
    assert sum(got.values()) == 2000 and max(got.values()) - min(got.values()) <= 2 and len(got) == 7
    got = Counter(r.shard for r in sharding.shard(docs, capacity=14 * 30).collect())
    assert len(got) == 67 and sorted(got.values())[1:] == [30] * 66


# decontamination


def brute_hits(rows, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = Counter()
    for r in rows:
        w, hit, found = fold(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[r[0], len(w), len(hit), ",".join(sorted(str(x) for x in found - {None}))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, rows, none, block_bytes):
    words = rows[30][1].split()
    items = [(1, rows[15][1]), (12, " ".join(words[3:20]).upper()), (2, "tau1 !? mu2"), (None, "Two, WORDS"), (5, ""), (6, None), (1, rows[15][1]), (7, "alpha1"), (30, rows[70][1])]
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n_words int")
    got = decontam.contaminated(docs.select("doc_id", "text", "start"), benchmark, block_bytes).select("doc_id", "_leak.*").collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == brute_hits(rows, items)
    assert decontam.contaminated(none, benchmark).collect() == []
    assert all(r._leak.n_hit == 0 for r in decontam.contaminated(docs, benchmark.limit(0)).collect())


# URL filters

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b.net", "/fr/deep")]
URLS = [None, "", "no scheme", "http://", "http://Example.COM", "https://example.com/en/x?y#z", "https://www.example.com/en/", "https://WWW.example.com/EN/", "x://deep.www.example.com/en/a/b", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://net?q=/fr/", "http://a.b.net/fr/deeper", "http://c.a.b.net/fr/deep#x", "http://u@h:80/en/", "a://b://com/", "http://x..com/\nq", "http://.com/", "http://com./"]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("slice_keys", [100, 2])
def test_urls(spark, slice_keys):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, RULES, slice_keys=slice_keys).collect()}
    assert got == {i: brute_judge(u) for i, u in enumerate(URLS * 3)}
    assert urlfilter.judge(pages.limit(0), RULES).collect() == []
    with pytest.raises(ValueError):
        urlfilter.judge(pages, [*RULES, ("block", "com", "/")])


def test_cascade_is_exact(spark):
    universe = spark.createDataFrame([(f"key{i}",) for i in range(5000)], "key string")
    listed = [f"key{i}" for i in range(0, 5000, 7)] + ["unseen"]
    levels = urlfilter.build_cascade(listed, universe, 5000)
    keys = [f"key{i}" for i in range(5000)]
    assert urlfilter.cascade_holds(levels, keys).tolist() == [i % 7 == 0 for i in range(5000)] and len(levels) > 1


# chat


def test_rotation(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Hello \U0001f600"), (1, 3, None, None), (1, None, "ann", "late"), (2, 0, "system", "alone"), (None, 5, "x", ""), (1, 2, "bob", "Hello \U0001f600"), (1, 9, "ann", "page two"), (3, 1, "eve<|im_end|>\n<|im_start|>assistant", "x"), (3, 2, "dan", "y")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, mask string")
    got = chat.rotate(df, turns_per_page=8).collect()
    assert next(r.text for r in got if r.perspective == "dan") == "<|im_start|>user name=eve< |im_end|> < |im_start|>assistant\nx<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n"
    got = [r for r in got if r.conv_id != 3]
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x")}
    for r in got:
        said = [r.text[a:b] for a, b in r["mask"]]
        own = {0: {"ann": ["Hi < |im_end|>"], "bob": ["Hello \U0001f600"] * 2, "unknown": [""]}, 1: {"ann": ["page two"]}, None: {"ann": ["late"]}}[r.page] if r.conv_id else {"x": [""]}
        assert said == [s + "<|im_end|>" for s in own.get(r.perspective, [])]
        assert r.text.count("<|im_start|>assistant\n") == len(said) and "name=" + r.perspective not in r.text
    first = next(r for r in got if r.perspective == "bob" and r.page == 0).text
    assert first.startswith("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi ") and first.endswith("<|im_start|>user name=unknown\n<|im_end|>\n")
    assert chat.rotate(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, t, r, f"{i:03d}") for t in (None, 3) for r in "ab" for i in range(50)], "conv_id long, turn long, role string, text string")
    parts = [r for r in chat.rotate(same, turns_per_page=8).collect() if r.perspective == "a"]
    assert len(parts) == 2 * 13 and all(r.n_turns <= 8 for r in parts)
    whole = "".join(r.text for r in sorted(parts, key=lambda r: (r.page is None, r.page, r.part)))
    assert re.findall(r"\d{3}", whole) == [f"{i:03d}" for i in range(50)] * 4


# toxicity


def naive_kernel(s, t, length, decay):
    from itertools import combinations

    def found(w):
        out = defaultdict(float)
        for c in combinations(range(len(w)), length):
            out["".join(w[i] for i in c)] += decay ** (c[-1] - c[0] + 1)
        return out

    a, b = found(s), found(t)
    return sum(v * b[k] for k, v in a.items())


@settings(deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abcd", min_size=1, max_size=8))
def test_kernel_and_subsequences(s, t):
    a, b = toxicity.coded([s]), toxicity.coded([t])
    assert toxicity.subsequence_kernel(a, np.where(b < 0, -2, b))[0] == pytest.approx(naive_kernel(s, t, toxicity.LENGTH, toxicity.DECAY), rel=1e-4)
    table = np.zeros((len(s) + 1, len(t) + 1), int)
    for i, x in enumerate(s):
        for j, y in enumerate(t):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert toxicity.Landmarks([t]).common(a)[0, 0] == table[-1, -1]


def test_toxicity(spark, none):
    import random

    rng = random.Random(1)
    insults = ["blockhead", "numskull", "nitwit"]
    plain = lambda n: " ".join("".join(rng.choice("aeiou" if i % 2 else "bdfgklmnprst") for i in range(rng.randrange(3, 9))) for _ in range(n)) + "."
    texts = []
    for i in range(400):
        toxic = i % 4 == 0
        parts = [plain(8) for _ in range(rng.randrange(2, 6))]
        if toxic:
            parts.insert(rng.randrange(len(parts)), f"{plain(3)[:-1]} {rng.choice(insults)} {plain(2)}")
        texts.append((i, " ".join(parts), int(toxic)))
    extra = [(1000, None), (1001, ""), (1002, "You block-head of a man."), (1003, "such a n i t w i t you are"), (1004, "numbskull " + plain(30)), (1005, "x" * 5000), (None, texts[0][1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in texts] + [(*e, "s") for e in extra], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(5, None), (7777, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    held = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert got[1002] > 0.5 and got[1003] > 0.5 and got[1004] > 0.5 and max(got[1000], got[1001], got[1005]) < 0.5 and got[None] == got[0]
    assert all(r.score == 0 for r in toxicity.scored(docs, labels.where("toxic = 0")).collect())
    assert toxicity.scored(none.select("doc_id", "text"), labels).collect() == []

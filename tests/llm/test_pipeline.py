"""Stages of corpus_pipeline on whole small tables."""

import random

import corpus_pipeline
import pytest
from loamdex.llm import decontam, mixing, simhash
from loamdex.llm.common import word_count
from pyspark.sql import functions as F

#: Those of documents, and some that operators and stages use for themselves.
CLASH = ["size", "target", "copies", "copy", "start", "_leak", "_key", "key", "row", "nth", "place", "node", "component", "score", "toxic", "shard", "found", "hits", "spot", "named"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]


@pytest.fixture(scope="module")
def sf_dir(spark, docs, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.select(*COLUMNS[:5]).withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASH}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[30][1]), (2, "mu2 nothing")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def intact(rows):
    """Every clashing column still has the document's own value."""
    return all(r[c] == f"own {c} {'' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH)


def test_stages(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    results = {name: stage(spark, docs, sf_dir) for name, stage in list(stages.items())[:-1]}
    assert all(df.columns == COLUMNS for df in results.values())
    results = {name: df.collect() for name, df in results.items()}
    assert all(intact(found) for found in results.values()) and results["toxicity"] and results["mixing"]
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in results["near_duplicates"])
    assert kept == brute_kept([(r[0], r[1]) for r in rows])
    leaks = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("_leak.n_hit > 0").count()
    assert leaks and len(results["decontamination"]) == len(rows) - leaks
    none = docs.limit(0)
    for stage in stages.values():
        assert stage(spark, none, sf_dir).collect() == []


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert got and all(sorted(s) == list(range(len(s))) for s in slots.values())


def shingles(text, k=corpus_pipeline.SHINGLE):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_groups(texts):
    """Numbers of the groups that links of shingle similarity 0.8 or more make."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return root


def brute_kept(rows):
    """The least doc_id of each group, null last."""
    least = {}
    for group, (doc_id, _) in zip(brute_groups([t for _, t in rows]), rows):
        least[group] = min(least.get(group, (True, 0)), (doc_id is None, doc_id or 0))
    return sorted(least.values())


def test_near_copies_are_found(spark):
    """Copies with words replaced, put in or cut off, down to a similarity of 0.8."""
    rng, texts = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    for _ in range(120):
        base = [word() for _ in range(rng.randrange(100, 400))]
        texts.append(base)
        while True:
            copy = list(base)
            for _ in range(rng.randrange(1, len(base) // 40 + 2)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()]
            copy = copy[rng.randrange(4) :]
            if 9 * len(shingles(" ".join(base)) & shingles(" ".join(copy))) >= 4 * (len(shingles(" ".join(base))) + len(shingles(" ".join(copy)))):
                texts.append(copy)
                break
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, docs, "").collect()}
    assert {i for i in range(0, 240, 2)} <= kept and sum(i not in kept for i in range(1, 240, 2)) >= 0.95 * 120


@pytest.mark.parametrize("set_rows", [1024, 3])
def test_links_are_checked_on_shingles(spark, rows, set_rows):
    line = "one very common line of many words that repeats " * 60
    texts = [r[1] for r in rows if len(r[1] or "") < 20_000] + [line + " ".join(f"t{k}w{i}" for i in range(100)) for k in range(6)]
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[:k] and [f"n{i}" for i in range(k)] + chain[k:]) for k in range(1, 60, 4)]
    # whatever the fingerprints say, all texts are candidates of two components here
    df = spark.createDataFrame([(i % 2, t, i) for i, t in enumerate(texts)], "component long, text string, k long").repartition(3)
    got = {r.k: r.part for r in simhash.verified(df, corpus_pipeline.SHINGLE, set_rows=set_rows).collect()}
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i % 2, i, 2):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                root[top(i)] = top(j)
    want, names = [top(i) for i in range(len(texts))], {}
    assert len(got) == len(texts) and all(names.setdefault(got[i], want[i]) == want[i] for i in got) and len(names) == len(set(want))


def test_texts_that_share_a_repeated_line_stay(spark, tmp_path):
    line = "one very common line of many words that repeats " * 60
    docs = spark.createDataFrame([(k, line + " ".join(f"t{k}w{i}" for i in range(100)), "en", "s", None) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r.component for r in simhash.near_duplicates(docs, shingle=corpus_pipeline.SHINGLE).collect()}) == 1
    assert corpus_pipeline.near_duplicates_out(spark, docs, str(tmp_path)).count() == 6


def test_mixed_documents_come_near_their_targets(spark):
    """Whole documents, source by source: within half a document and a block of the target."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = corpus_pipeline.mixed(spark, docs, "").groupBy("source").agg(F.sum(word_count("text")).alias("words")).collect()
    plan = mixing.mix(docs.select("doc_id", "text", "source")).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("longest"))
    want = {r.source: r for r in plan.collect()}
    assert len(got) == len(want) and all(abs(r.words - want[r.source].target) <= want[r.source].longest / 2 + mixing.BLOCK for r in got)

"""Search, index, audit, store and sync on small fixtures; queries against their SQL."""

import json
import math
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from loamdex import errors
from loamdex.functions import providers as P
from loamdex.functions import text as T
from loamdex.functions import vectors as V
from loamdex.operators import audit, delta, search, similarity
from loamdex.plans import queries, reports
from loamdex.sources import notes, store
from loamdex.streaming import sync
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_text_functions(spark):
    assert [one(spark, T.stable_hash, t) for t in ("", "hello", "Привет 😀", "Body.")] == ["811c9dc59e3779b9", "4f9f2cabc497deb1", "209c243cc27a9835", "7a585661d97ed1a2"]
    assert one(spark, T.preview, "  a　﻿ b\n") == "a b" and one(spark, T.preview, " \n") is None
    assert one(spark, T.utf16_length, "a😀") == 3
    assert one(spark, T.wiki_link, "A/b.md") == "[[A/b|b]]" and one(spark, T.wiki_link, "b.md") == "[[b]]"
    assert one(spark, T.flashcards, "```\n- a::b\n2. c ::d\n::no\nno::\n* x\n```") == "a::b\nc ::d"
    assert one(spark, T.file_name, ' a/b:*?"<>|#^[c]  d ') == "a b c d"
    assert one(spark, T.topic_slug, "Hello, мир 1!") == "Hello-мир-1" and one(spark, T.topic_slug, "?!") == "response"
    assert one(spark, T.repetition_loop, "x" * 500) is True and one(spark, T.repetition_loop, " " * 500) is False
    assert one(spark, T.repetition_loop, "".join(chr(97 + i * i % 26) for i in range(150)) + "0123456789abcdefghij" * 15) is True
    assert [one(spark, T.valid_path, p) for p in ("a/b.md", "", " a", "/a", "C:x", "a\\b", "a//b", "a/../b", "./a", "a\0", None)] == [True] + [False] * 10
    assert one(spark, T.dataview_query, "```dataview\nTABLE x\n```") == "TABLE x" and one(spark, T.dataview_query, "Sure! TABLE") is None
    assert one(spark, T.folder_ancestors, "a/b/c.md") == ["a", "a/b"] and one(spark, T.folder_ancestors, "c.md") == []
    assert one(spark, lambda c: T.links(c), "[[A|x]] ![[B]] [[C#d]]") == ["A", "C"]
    assert one(spark, lambda c: T.append_section(c, F.lit("b")), "a \n\n") == "a\n\nb\n"


def test_vector_functions(spark):
    assert one(spark, V.scaled_norm, [3e200, 4e200], "array<double>") == pytest.approx(5e200)
    assert one(spark, V.unit_f32, [3.0, 4.0], "array<double>") == [np.float32(0.6), np.float32(0.8)]
    assert one(spark, V.unit_f32, [0.0, 0.0], "array<double>") is None and one(spark, V.unit_f32, [math.nan], "array<double>") is None
    assert one(spark, V.unit_f32, [1e39], "array<double>") is None


CHUNKS = "id string, path string, ordinal int, vector array<float>, preview string"
LONG = "meaningful semantic note content with enough characters"


def chunks_of(spark, *rows):
    return spark.createDataFrame([(i, p, o, [float(x) for x in v], LONG) for i, p, o, v in rows], CHUNKS)


def test_grouping_and_ties(spark):
    at = lambda s: [s, math.sqrt(1 - s * s)]
    df = chunks_of(spark, *[(i, p, 0, at(s)) for i, p, s in (("a1", "A", 0.9), ("a2", "A", 0.8), ("b1", "B", 0.7), ("a3", "A", 0.6), ("a4", "A", 0.5))])
    got = [(r.path, round(r.document_score, 3), r.id) for r in search.grouped(df, [1, 0], matches=2).orderBy(F.desc("document_score"), "match_rank").collect()]
    assert got == [("A", 0.9, "a1"), ("A", 0.9, "a2"), ("B", 0.7, "b1")]
    ties = chunks_of(spark, *[(p, p, 0, [1, 0]) for p in ("z.md", "A.md", "a.md", "\U0001f600", "￮")])
    assert [r.id for r in search.knn(ties, [1, 0]).collect()] == ["A.md", "a.md", "z.md", "\U0001f600", "￮"]
    assert search.knn(ties, [1, 0], min_score=1.1).collect() == [] and search.knn(ties, [1, 0], limit=9, exclude_paths=["z.md"]).count() == 4
    with pytest.raises(errors.ValidationError):
        search.grouped(df, [1, 0], limit=101)
    with pytest.raises(errors.ValidationError):
        search.checked_query("x" * 2001)


def test_centroids_similar_and_duplicates(spark):
    df = chunks_of(spark, ("1", "S", 0, [1, 0]), ("2", "S", 1, [0, 1]), ("3", "X", 0, [1, 0]), ("4", "Y", 0, [0, 1]), ("5", "N", 0, [1, 0]), ("6", "N", 1, [-1, 0]))
    got = {r.path: r.document_score for r in search.similar(df, "S").collect()}
    assert got == {"X": pytest.approx(math.sqrt(0.5)), "Y": pytest.approx(math.sqrt(0.5))}  # N points every way
    with pytest.raises(errors.SourceNotIndexedError):
        search.similar(df, "none")
    assert search.similar(df.limit(0), "S").collect() == [] and search.similar(df, "N").collect() == []
    short = df.where("path <> 'N'").withColumn("preview", F.when(F.col("path") == "X", "x" * 31).otherwise("y" * 32))
    assert {r.path for r in search.eligible(search.centroids(short)).collect()} == {"S", "Y"}
    angle = lambda x: [math.cos(x), math.sin(x)]
    df = chunks_of(spark, ("z", "Z", 0, [1, 0]), ("a", "A", 0, angle(0.2)), ("m", "M", 0, angle(0.05)))
    assert [(r.left_path, r.right_path) for r in similarity.duplicates(search.centroids(df)).collect()] == [("M", "Z"), ("A", "M"), ("A", "Z")]


@pytest.mark.parametrize(("cell_rows", "threshold"), [(2000, 0.3), (7, 0.3), (7, 0.9), (7, -0.2)])
def test_similarity_join_is_exact(spark, cell_rows, threshold):
    rng = np.random.default_rng(2)
    v = np.vstack([rng.normal(size=(50, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(20, 6)) * 0.1])
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(f"p{i:03}", x.tolist()) for i, x in enumerate(v)], "path string, centroid array<double>")
    got = sorted((r.left_path, r.right_path) for r in similarity.pairs_above(df, threshold, pivots=5, cell_rows=cell_rows).collect())
    assert got == [(f"p{i:03}", f"p{j:03}") for i in range(70) for j in range(i + 1, 70) if v[i] @ v[j] >= threshold]


def test_equal_documents_are_one_class(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 5))
    v = np.vstack([base, base + rng.normal(size=(6, 5)) * 0.1])
    v /= np.linalg.norm(v, axis=1)[:, None]
    of = [i % 12 if i < 24 else 3 for i in range(90)]
    paths = [f"p{rng.integers(1000):03}-{i}" for i in range(90)]
    df = spark.createDataFrame([(p, v[k].tolist(), None) for p, k in zip(paths, of)], "path string, centroid array<double>, chars long").repartition(3)
    pairs = similarity.class_pairs(df, 0.95).collect()
    assert len({(r.left_path, r.right_path) for r in pairs}) == len(pairs) == sum(v[i] @ v[j] >= 0.95 for i in range(12) for j in range(i))
    members = similarity.class_members(df).collect()
    group = {}
    for r in members:
        group.setdefault(r.representative, []).append(r.path)
    assert len(members) == 90 and len(group) == 12 and all(min(g) == k and len(g) == r.copies for r in members for k, g in [(r.representative, group[r.representative])])
    told = {tuple(sorted((a, b))) for g in group.values() for a in g for b in g if a < b} | {tuple(sorted((a, b))) for r in pairs for a in group[r.left_path] for b in group[r.right_path]}
    every = similarity.pairs_above(df, 0.95).collect()
    assert told == {(r.left_path, r.right_path) for r in every}
    for limit in (1, 7, 40, 500):
        best = [(r.left_path, r.right_path) for r in similarity.duplicates(df, 0.95, limit).collect()]
        assert best == [(r.left_path, r.right_path) for r in sorted(every, key=lambda r: (-r.score, r.left_path, r.right_path))][:limit]


def test_near_duplicate_classes_reach_the_default(spark):
    found = queries.near_duplicate_classes(spark, SF).collect()
    assert search.THRESHOLD == 0.95 and any(0.95 <= r.score < 0.985 for r in found)
    assert {r.representative for r in queries.near_duplicate_members(spark, SF).collect()} >= {p for r in found for p in (r.left_path, r.right_path)}


def test_many_one_hot_documents(spark):
    df = spark.createDataFrame([(f"d{i:03}", [float(k == i % 8) for k in range(8)]) for i in range(500)], "path string, centroid array<double>")
    assert similarity.pairs_above(df, 1.0).count() == sum(n * (n - 1) // 2 for n in (63,) * 4 + (62,) * 4)


def test_delta_modes(spark):
    schema = "id string, path string, ordinal int, content_hash string, heading_path array<string>, preview string"
    committed = spark.createDataFrame([("1", "a", 0, "x", ["h"], None), ("2", "a", 1, "y", ["h"], "p"), ("3", "b", 0, "z", ["h"], None)], schema)
    new = spark.createDataFrame([("1", "a", 0, "x", ["h"], None), ("2", "a", 1, "y", ["other"], "p"), ("4", "c", 0, "n", ["h"], None)], schema)
    docs = spark.createDataFrame([("a",), ("c",), ("empty",)], "path string")
    states = delta.classify(new, committed, docs)
    assert {(r.id, r.status) for r in states.collect()} == {("1", "unchanged"), ("2", "changed"), ("4", "new")}
    deletes = spark.createDataFrame([("b",), ("never",)], "path string")
    assert delta.counters(states, docs, committed, deletes).first().asDict() == {"documents_seen": 5, "documents_changed": 2, "documents_unchanged": 2, "documents_deleted": 1, "chunks_seen": 3, "chunks_embedded": 2, "chunks_deleted": 1}
    assert [r.path for r in delta.missing_paths(docs, committed).collect()] == ["b"]
    merged = delta.merge(committed, new.where("id <> '1'"), None, deletes)
    assert sorted(r.id for r in merged.collect()) == ["1", "2", "4"]
    assert [r.id for r in delta.collisions(new.withColumn("path", F.lit("q")), committed).orderBy("id").collect()] == ["1", "2"]
    with pytest.raises(errors.ValidationError):
        delta.checked_input(docs, docs)
    with pytest.raises(errors.ValidationError):
        delta.checked_input(docs.union(docs))


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("b", "p", 0, ["h"], "x", 0, 1, 0, 0, None, [1.0, 0.0]), ("a", "p", 1, ["h"], "y", 1, 2, 0, 0, "p", [0.6, 0.8])], store.SCHEMA)
    s = store.GenerationStore(spark, str(tmp_path / "index"), "space", 2)
    assert s.probe() == "absent" and s.stats()["count"] == 0
    with pytest.raises(errors.NotInitializedError):
        s.read()
    assert s.commit(rows).generation == 1 and s.probe() == "present"
    before = s.read()
    assert s.commit(rows.limit(1), expected=1).generation == 2 and s.read().count() == 1
    assert before.count() == 2  # readers keep their generation
    with pytest.raises(errors.PersistenceError):
        s.commit(rows, expected=1)
    assert s.commit(rows, should_commit=lambda: False) is None and s.manifest().generation == 2
    with pytest.raises(errors.CorruptionError):
        s.commit(rows.withColumn("vector", F.array(F.lit(2.0).cast("float"), F.lit(0.0).cast("float"))))
    assert s.manifest().generation == 2  # a crash before the pointer moves leaves the old state
    with pytest.raises(errors.CompatibilityError):
        store.GenerationStore(spark, str(tmp_path / "index"), "other", 2).read()
    assert s.clear().count == 0 and s.read().count() == 0 and s.stats()["generation"] == 3
    (tmp_path / "index" / "_CURRENT").write_text("{")
    assert s.probe() == "corrupt"
    (tmp_path / "index" / "mine").write_text("kept")
    s.reset()
    assert s.probe() == "absent" and (tmp_path / "index" / "mine").exists()
    assert store.NullStore(spark).read().collect() == []
    for bad in ("", "a/../b", "a\0b"):
        with pytest.raises(errors.ValidationError):
            store.base_path(bad)


def test_vault_and_links(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "A.md").write_text("---\ntags: [x, '#y']\n---\nSee [[B]], [[B]] and [[gone]] #inline", "utf-8")
    (tmp_path / "sub dir" / "B.MD").write_text("text", "utf-8")
    (tmp_path / "c.txt").write_text("no", "utf-8")
    vault = notes.with_metadata(notes.read_vault(spark, str(tmp_path)))
    got = {r.path: r for r in vault.collect()}
    assert set(got) == {"A.md", "sub dir/B.MD"} and got["A.md"].n_links == 3 and got["A.md"].tags[0] == "#inline" and "#x" in got["A.md"].tags
    assert [(r.src, r.dst, r.cnt) for r in notes.resolved_links(vault).collect()] == [("A.md", "sub dir/B.MD", 2)]
    found, missing = notes.read_paths(vault, spark.createDataFrame([("A.md",), ("x.md",), ("c.txt",), ("A.md",)], "path string"))
    assert [r.path for r in found.collect()] == ["A.md"] and sorted(r.path for r in missing.collect()) == ["c.txt", "x.md"]


def test_audit_pieces(spark):
    names = spark.createDataFrame([(p,) for p in ("a.md", ".config/x.md", "Templates/t.md", ".ai-backup-1/y.md", "d/.hidden.md", "z.txt")], "path string")
    assert [r.path for r in audit.collected(names).collect()] == ["a.md"]
    assert audit.collected(names, backups=False, dot_names=False, templates_any_case=False).count() == 4
    assert audit.estimate(11) == {"batches": 3, "requests": 5, "minutes": 1, "single_minutes": 2}
    answers = spark.createDataFrame([("n", '```json\n{"mainIdea": "i", "keyPoints": ["1","2","3","4","5","6","7","8"], "quality": "odd"}\n```'), ("m", "nothing"), ("p", '{"quality": "polished", "topics": ["t"], "entities": "e"}'), ("d", '{"quality": "developed"} and more')], "b string, a string")
    good, bad, polished, developed = (r[0] for r in answers.select(audit.coerced_record("a", F.lit(7), F.lit(0))).collect())
    assert len(good.keyPoints) == 7 and good.quality == "draft" and good.entities == [] and good.wordCount == 7 and good.orphan
    assert "read" in bad.mainIdea and bad.quality == "draft" and polished.quality == "polished" and developed.quality == "developed" and developed.mainIdea == ""
    sizes = spark.createDataFrame([(f"n{i}", s) for i, s in enumerate((3, 3, 9, 20, 1, 1, 1, 1))], "path string, size long")
    assert [r.batch for r in audit.packed(sizes, 3, 10).orderBy("path").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]
    assert audit.packed(sizes, 3, 10, parts=2).count() == 8


@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_packing_is_one_fold_for_any_ranges(spark, parts):
    rng = np.random.default_rng(parts)
    sizes = [None if i % 17 == 5 else int(x) for i, x in enumerate(rng.choice([0, 1, 2, 3, 9, 30], 90))]
    batch, n, chars, want = 0, 0, 0, {}
    for i, size in enumerate(sizes):
        size = size or 0
        grown = chars + size
        if n and (n >= 5 or grown > 10):
            batch, n, grown, want_position = batch + 1, 0, size, 0
        else:
            want_position = n
        n, chars, want[f"n{i:03}"] = n + 1, grown, (batch, want_position)
    df = spark.createDataFrame([(f"n{i:03}", s) for i, s in enumerate(sizes)], "path string, size long").repartition(4)
    got = audit.packed(df, 5, 10, parts=parts).collect()
    assert {r.path: (r.batch, r.position) for r in got} == want and len(got) == 90
    assert parts == 1 or len({r.part for r in got}) > 1
    assert audit.packed(df.limit(0), 5, 10, parts=parts).collect() == []


def test_cluster_members_are_rows(spark):
    rows = [(1, " A ", "x" * 40, ["p", "q", "p"], " "), (2, "a", "y", ["r", "q"], "M"), (3, "", None, None, None), (4, "", "z", ["p"], None)]
    clusters = spark.createDataFrame(rows, "seq long, name string, description string, paths array<string>, moc string")
    members = sorted((r.key, r.seq, r.place, r.path) for r in audit.cluster_members(clusters).collect())
    assert members == [("#4", 4, 0, "p"), ("=a", 1, 0, "p"), ("=a", 1, 1, "q"), ("=a", 2, 0, "r")]
    heads = {r.key: (r.seq, r.description, r.moc, r.file_count) for r in audit.cluster_heads(clusters).collect()}
    assert heads == {"=a": (1, "x" * 40, "M", 3), "#3": (3, "", None, 0), "#4": (4, "z", None, 1)}
    whole = {r.seq: r.paths for r in audit.dedupe_clusters(clusters).collect()}
    assert whole == {1: ["p", "q", "r"], 3: [], 4: ["p"]}


def test_reports(spark):
    clusters = spark.createDataFrame([(0, "One", "about", [f"d/n{i}.md" for i in range(25)], None, 0, 2), (1, "Two", "", ["a.md"], "Map", 1, 2)], "seq int, name string, description string, paths array<string>, moc string, i int, total int")
    first = reports.cluster_report(clusters).orderBy("seq").first().section
    assert first.count("[[") == 20 and first.endswith("…and 5 more")
    xy = [(r.x, r.y, r.color) for r in reports.cluster_canvas(clusters).orderBy("id").collect()]
    assert xy == [(525, -125, "1"), (-875, -125, "2")]
    canvas = json.loads(reports.canvas_json(reports.cluster_canvas(clusters)).first().canvas)
    assert len(canvas["nodes"]) == 3 and len(canvas["edges"]) == 2
    assert [r.file_name for r in reports.moc_notes(clusters).orderBy("seq").collect()] == ["One", "Two"]


def test_providers(spark):
    docs = spark.createDataFrame([("beta two",), ("x",)], "text string")
    assert len(P.embedded(docs, P.HashedBow).first().vector) == 64
    assert P.completed(docs, P.Excerpts, "s", "text").where("error IS NULL").count() == 2
    assert P.in_order([{"index": 1, "embedding": 2}, {"index": 0, "embedding": 1}]) == [1, 2]
    for bad in ([{"index": 0, "embedding": 1}, {"index": 0, "embedding": 1}], [{"index": 0, "embedding": 1}, {"embedding": 1}]):
        with pytest.raises(errors.ProviderContractError):
            P.in_order(bad)
    for bad in ([[0.0, 0.0]], [[1e39]], [[float("nan")]], []):
        with pytest.raises(errors.ProviderContractError):
            P.checked_vectors(bad, 1)
    waits = []
    with pytest.raises(errors.ProviderError):
        P.with_retry(lambda: 1 / 0, 2, sleep=waits.append)
    assert waits == [1, 2]
    space = P.space_id(P.EmbeddingSettings("openai-compatible", "model|with=delimiters", " HTTPS://Example.COM/v1/ ", 3))
    assert "model=model%7Cwith%3Ddelimiters" in space and "endpoint=https%3A%2F%2Fexample.com%2Fv1" in space
    assert P.endpoint("http://h/v1/", "/embeddings") == "http://h/v1/embeddings" == P.endpoint("http://h/v1/embeddings", "embeddings")
    assert P.fill("{a}{b}{c}", {"a": "{b}", "b": "1"}) == "{b}1{c}"


def test_truncation(spark):
    mark = "\n\n*[truncated]*"
    front = "---\na: b\n---\n"
    cases = [
        ("short", "short"), ("x" * 300, "x" * 200 + "…" + mark), ("a" * 120 + "\n\n" + "b" * 120, "a" * 120 + "\n\n" + "b" * 78 + "…" + mark),
        ("# a\n" + "x" * 150 + "\n# b\n" + "y" * 150, "# a\n" + "x" * 96 + "…" + "# b\n" + "y" * 95 + "…" + mark),
        (front + "# a\n" + "x" * 10 + "\n## b\n" + "y" * 300, front + "# a\n" + "x" * 10 + "\n## b\n" + "y" * 88 + "…" + mark),
        ("---\n" + "k: v\n" * 30 + "---\n" + "z" * 100, ("---\n" + "k: v\n" * 30 + "---\n" + "z" * 100)[:200] + "\n…"), (None, None),
    ]
    got = [r[0] for r in spark.createDataFrame([(c,) for c, _ in cases], "c string").select(T.truncated("c", 200)).collect()]
    assert got == [want for _, want in cases]


def test_loops_count_blanks_inside(spark):
    block = "ab" + " " * 16 + "cd"
    text = "".join(chr(97 + i * i % 26) for i in range(400)) + block * 3
    assert one(spark, T.repetition_loop, text) is True
    assert one(spark, T.repetition_loop, "".join(chr(97 + i * i % 26) for i in range(400)) + (" " * 16 + "abcd") * 3) is False


EVENTS = "op string, path string, new_path string, ts timestamp, seq long"


def test_sync_batches(spark):
    at = lambda ms: datetime.fromtimestamp(1_700_000_000 + ms / 1000)
    rows = [("create", "a.md", None, 0, 0), ("modify", "a.md", None, 1500, 1), ("delete", "a.md", None, 3001, 2), ("rename", "b.md", "c.md", 3001, 3), ("rename", "c.md", "d.txt", 3002, 4), ("modify", "x.txt", None, 3003, 5), ("create", "e.md", None, 90_000, 6), ("reconcile", None, None, 90_001, 7), ("delete", "e.md", None, 90_002, 8)]
    df = spark.createDataFrame([(o, p, n, at(t), s) for o, p, n, t, s in rows], EVENTS)
    got = {(r.session, r.reconcile_all, r.path, r.op) for r in sync.sync_batches(df).collect()}
    assert got == {(1, False, "a.md", "upsert"), (2, False, "a.md", "delete"), (2, False, "b.md", "delete"), (2, False, "c.md", "delete"), (3, True, None, None)}


def test_follow_stream(spark, tmp_path):
    source, flushed, fail = str(tmp_path / "events"), [], [True]

    def flush(batch):
        if fail.pop() if fail else False:
            raise RuntimeError("provider")
        flushed.append(batch)

    state = sync.AutoSync(flush)
    row = lambda op, path, seq: (op, path, None, datetime(2024, 1, 1), seq)
    spark.createDataFrame([row("create", "a.md", 0), row("delete", "b.md", 1)], EVENTS).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    sync.follow(stream, state, str(tmp_path / "ck"), availableNow=True).awaitTermination(60)
    assert flushed == [] and state.pending == {"a.md": "upsert", "b.md": "delete"}
    spark.createDataFrame([row("create", "b.md", 2)], EVENTS).write.mode("append").parquet(source)
    sync.follow(stream, state, str(tmp_path / "ck"), availableNow=True).awaitTermination(60)
    assert flushed == [{"epoch": 0, "reconcile_all": False, "upserts": ["a.md", "b.md"], "deletes": []}]
    state.reconfigure(paused=True, reconcile=True)
    state.run()
    assert len(flushed) == 1 and not state.should_commit(0)
    state.reconfigure(paused=False)
    state.run()
    assert flushed[-1]["reconcile_all"] and state.should_commit(2)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLE:
        assert got
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    order = [[c[0] for c in want.description].index(c) for c in df.columns]
    plain = lambda rows: sorted(tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_a_group_of_the_join_is_bounded():
    """pairs leave a group in small batches, and no more than the best where only those are wanted."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    paths = [f"p{i:03}" for i in rng.permutation(400)]
    want = sorted(((float(v[i] @ v[j]), *sorted((paths[i], paths[j]))) for i in range(400) for j in range(i)), key=lambda r: (-r[0], r[1:]))

    def found(kinds, **options):
        columns = {"path": paths, "centroid": v.tolist(), "order": [p.encode("utf-16-be") for p in paths], "row": kinds}
        batch = pa.RecordBatch.from_pydict(columns, pa.schema({"path": pa.string(), "centroid": pa.list_(pa.float64()), "order": pa.binary(), "row": pa.bool_()}))
        return list(similarity.matcher(-1.0, False, False, **options)(iter([batch.slice(0, 150), batch.slice(150)])))

    every = found([None] * 400, best=0)
    assert len(every) > 1 and max(b.num_rows for b in every) <= similarity.SCORED
    assert {(r["left_path"], r["right_path"]) for b in every for r in b.to_pylist()} == {r[1:] for r in want} and sum(b.num_rows for b in every) == len(want)
    halves = found([i < 200 for i in range(400)], best=0)
    assert sum(b.num_rows for b in halves) == 200 * 200
    [best] = found([None] * 400, best=9)
    assert [(r["left_path"], r["right_path"]) for r in best.to_pylist()] == [r[1:] for r in want[:9]]


def test_classes_compute_documents_once(spark):
    """what makes the vectors runs once for each document, though classes and members both need them."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        calls.add(1)
        return [float(i % 5), 1.0]

    df = spark.range(40).select(F.concat(F.lit("p"), "id").alias("path"), vector("id").alias("centroid"))
    assert similarity.class_members(df).select("representative").distinct().count() == 5
    assert calls.value == 40


def test_a_norm_is_computed_once_for_each_vector(spark, capsys):
    """not once for each entry, which made the work grow with the square of the size."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,), ([],)], "v array<float>").select(V.unit_f32("v").alias("u"))
    df.explain()
    assert capsys.readouterr().out.count("aggregate(") == 1
    assert [r.u and np.float32(r.u).tolist() for r in df.collect()] == [np.float32([0.6, 0.8]).tolist(), None, None, None, None]


def test_classes_of_equal_vectors_whatever_zero_and_nan_look_like(spark):
    """the hash that is compared first agrees with equality."""
    zero, nan = [("b", [0.0, 1.0]), ("a", [-0.0, 1.0])], [("d", [float("nan")]), ("c", [-float("nan")]), ("e", [2.0]), ("f", None)]
    found = similarity.class_members(spark.createDataFrame(zero + nan, "path string, centroid array<double>")).collect()
    assert sorted(map(tuple, found)) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 2), ("d", "c", 2), ("e", "e", 1)]


def test_a_filter_on_centroids_does_not_repeat_their_norm(spark, capsys):
    """a filter on the centroid repeated the norm for each entry of each document."""
    df = chunks_of(spark, ("1", "a", 0, [3, 4]), ("2", "a", 1, [3, 4]), ("3", "b", 0, [1, 0]), ("4", "b", 1, [-1, 0])).drop("preview")
    found = search.centroids(df).where("centroid IS NOT NULL")
    found.explain()
    assert capsys.readouterr().out.count("SQRT(") == 2  # once in the filter, once in the result
    assert [(r.path, r.centroid) for r in found.collect()] == [("a", [0.6, 0.8])]


def _group(v, kinds):
    paths = [f"p{i:05}" for i in range(len(v))]
    columns = {"path": paths, "centroid": v.tolist(), "order": [p.encode("utf-16-be") for p in paths], "row": kinds}
    return pa.RecordBatch.from_pydict(columns, pa.schema({"path": pa.string(), "centroid": pa.list_(pa.float64()), "order": pa.binary(), "row": pa.bool_()}))


def test_what_is_far_away_is_not_multiplied(monkeypatch):
    """only rows near a box meet it, and all pairs are found, whatever is at the threshold, not finite or not of unit length."""
    rng = np.random.default_rng(8)
    v = np.repeat(np.eye(12)[:6], 700, axis=0) + rng.normal(size=(4200, 12)) * 0.1
    v = rng.permutation(v / np.linalg.norm(v, axis=1)[:, None])
    looked, hits = [], similarity.hits
    monkeypatch.setattr(similarity, "hits", lambda near, floor: (looked.append(near.size), hits(near, floor))[1])
    for threshold in (0.98, float(np.sort(v @ v[5])[-30])):
        for ordered, kinds in ((False, [None] * 4200), (False, [i % 3 == 0 for i in range(4200)]), (True, [i % 3 == 0 for i in range(4200)])):
            looked.clear()
            got = [(r["left_path"], r["right_path"]) for b in similarity.matcher(threshold, ordered, False, 0)(iter([_group(v, kinds)])) for r in b.to_pylist()]
            fold = np.zeros((4200, 4200))
            for k in range(12):
                fold += v[:, k, None] * v[None, :, k]
            i, j = np.nonzero(np.triu(fold >= threshold, 1))
            one, two = i % 3 == 0, j % 3 == 0
            meet = np.full(len(i), True) if kinds[0] is None else one & ~two if ordered else one != two
            assert sorted(got) == [(f"p{a:05}", f"p{b:05}") for a, b in zip(i[meet], j[meet])] and len(got) > 100
            if threshold == 0.98:
                assert sum(looked) < 0.75 * (4200 * 4200 / 2 if kinds[0] is None else 1400 * 2800)
    odd = np.array([[math.nan, 1.0], [math.inf, 0.0], [3.0, 0.0], [0.0, 0.0], [1.0, 0.0]])
    [batch] = similarity.matcher(0.9, False, False, 0)(iter([_group(odd, [None] * 5)]))
    assert [(r["left_path"], r["right_path"], r["score"]) for r in batch.to_pylist()] == [("p00002", "p00004", 1.0)]


def test_documents_that_share_a_path_stay_apart(spark, tmp_path):
    """numbers of seven digits lose their last in a path, in SQL too; such documents were merged."""
    words = ("red green blue white", "one two three four", "red green blue white", "one two three four")
    rows = [(i, t, "en", "s", len(t)) for i, t in zip((1234560, 1234561, 2, 3), words)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["near_duplicate_documents"]).fetchall()
    got = queries.near_duplicate_documents(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 2
    assert len(queries.near_duplicate_members(spark, str(tmp_path)).collect()) == 4


def test_pairs_compute_documents_once(spark):
    """what makes the vectors runs once for each document, though vectors that are null are left out."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        calls.add(1)
        return [1.0, 0.0] if i % 4 else None

    df = spark.range(40).select(F.concat(F.lit("p"), "id").alias("path"), vector("id").alias("centroid"))
    assert similarity.pairs_above(df, 0.9).count() == 30 * 29 // 2
    assert calls.value == 40

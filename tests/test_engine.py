"""The index end to end, with an offline provider."""

import numpy as np
import pytest
from loamdex import errors
from loamdex.functions import providers as P
from loamdex.operators.chunker import Options
from loamdex.plans.engine import NoteIndex
from loamdex.sources import records
from loamdex.sources.store import GenerationStore


def providers():
    """Local classes, so that they travel to the workers whole: [0,1,0] for beta, [0,0,1] for gamma, else [1,0,0]; and one that fails."""

    class Keywords:
        def dimensions(self):
            return 3

        def embed(self, texts):
            return [np.array([0, 1, 0] if "beta" in t else [0, 0, 1] if "gamma" in t else [1, 0, 0], np.float32) for t in texts]

    class Failing(Keywords):
        def embed(self, texts):
            raise RuntimeError("no")

    return Keywords, Failing


def notes_of(spark, **notes):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in notes.items()] or [], "path string, content string")


LONG = " and some more words to be eligible here"


def test_index_lifecycle(spark, tmp_path):
    Keywords, Failing = providers()
    index = NoteIndex(GenerationStore(spark, str(tmp_path / "i"), "s", 3), Keywords, Options())
    assert index.status() == "not-initialized" and index.flush({"reconcile_all": True}, lambda p: None) is None
    with pytest.raises(errors.NotInitializedError):
        index.search("x")
    first = index.update(notes_of(spark, a="# A\n\nalpha" + LONG, b="# B\n\nbeta" + LONG, c="# C\n\ngamma" + LONG, e=""), mode="reconcile")
    assert (first["documents_seen"], first["documents_changed"], first["documents_unchanged"], first["chunks_embedded"], first["generation_after"]) == (4, 3, 1, 3, 1)
    assert [(r.path, round(r.score, 6)) for r in index.search(" beta ", limit=1).collect()] == [("b.md", 1.0)]
    told = []
    same = index.update(notes_of(spark, a="# A\n\nalpha" + LONG), on_progress=told.append)
    assert told == [{"phase": "chunked", "chunks": 1}]
    assert (same["documents_unchanged"], same["committed"], same["generation_after"]) == (1, False, 1)
    guarded = index.update(notes_of(spark, a="# A\n\nbeta" + LONG), should_commit=lambda: False)
    assert not guarded["committed"] and index.store.manifest().generation == 1
    failing = NoteIndex(index.store, Failing)
    with pytest.raises(Exception, match="."):
        failing.update(notes_of(spark, a="# A\n\nnew"))
    assert index.store.manifest().generation == 1
    content = {"a.md": "# A\n\nbeta" + LONG}
    read = lambda wanted: spark.createDataFrame([(p, content[p]) for p in wanted if p in content], "path string, content string")
    index.update(notes_of(spark, a="# A\n\nbeta two" + LONG), should_commit=lambda: False, on_progress=told.append)
    assert told[1:] == [{"phase": "chunked", "chunks": 1}, {"phase": "embedded", "vectors": 1}]
    synced = index.flush({"reconcile_all": False, "upserts": ["a.md", "lost.md"], "deletes": ["c.md"]}, read)
    assert (synced["documents_seen"], synced["documents_changed"], synced["documents_unchanged"], synced["documents_deleted"], synced["chunks_deleted"], synced["generation_after"]) == (3, 1, 1, 1, 2, 2)
    pairs = index.duplicates().collect()
    assert {(r.left_path, r.right_path) for r in pairs} == {("a.md", "b.md")} and len(pairs) == 2
    assert [r.path for r in index.similar("a.md").collect()] == ["b.md"]
    gone = index.update(notes_of(spark, b="# B\n\nbeta" + LONG), mode="reconcile")
    assert (gone["documents_deleted"], gone["chunks_deleted"], gone["generation_after"]) == (1, 1, 3)
    assert index.delete(spark.createDataFrame([("b.md",), ("x.md",)], "path string"))["documents_unchanged"] == 1
    assert index.search("x").collect() == [] and index.status() == "ready"
    for bad in (dict(mode="sync"), dict(mode="other"), dict(delete_paths=notes_of(spark, a=""))):
        with pytest.raises(errors.ValidationError):
            index.update(notes_of(spark, a="x"), **bad)
    with pytest.raises(Exception, match="canonical"):
        index.update(spark.createDataFrame([("../a.md", "x")], "path string, content string"))


def test_records(spark, tmp_path):
    path = str(tmp_path / "records")
    assert records.load_records(spark, path).collect() == []
    row = spark.createDataFrame([("a.md", 1, 2, "i", [], [], "good", [], 3, None, None, None, None)], records.SCHEMA)
    records.save_records(row, path)
    records.save_records(row.union(row.selectExpr("'b.md' AS path", *[c for c in row.columns if c != "path"])), path)
    assert sorted(r.path for r in records.load_records(spark, path).collect()) == ["a.md", "b.md"]


def test_responses(spark):
    raw = spark.createDataFrame([('{"choices": [{"message": {"content": "hi"}}]}', '{"error": {"code": 429, "message": "secret"}}', '{"models": [{"name": "m"}, {}]}'), ("{}", "{}", "bad")], "a string, b string, c string")
    got = raw.select(P.chat_content("a").alias("a"), P.error_code("b").alias("b"), P.model_names("c").alias("c")).collect()
    assert tuple(got[0]) == ("hi", 429, ["m"]) and got[1].a is None and got[1].b is None
    models = spark.createDataFrame([(f"m{i}:free", f"M{i} (free)", i) for i in range(15)] + [("paid", "P", 99)], "id string, name string, context long")
    free = P.free_models(models).collect()
    assert len(free) == 12 and free[0].name == "M14"
    assert [r[0] for r in spark.createDataFrame([("É.MD",)], "p string").select(P.path_key("p")).collect()] == ["é.md"]

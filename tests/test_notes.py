"""Guards, formats, contracts, models' answers and rewriting."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loamdex.functions import providers as P
from loamdex.functions import text as T
from loamdex.operators import audit, contract
from loamdex.plans import reports, rewrite
from loamdex.plans.engine import NoteIndex
from loamdex.sources import notes as N
from loamdex.sources import records
from loamdex.sources.store import GenerationStore


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scores_round_the_binary_value(spark):
    values = [0.0625, -0.0625, 1.0005, 0.9995, 0.0005, -0.0001, 0.0, 1.0, 123456.78949999999, float("nan"), float("inf"), float("-inf"), None]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(T.score_text("v").alias("s")).collect()]
    assert got == ["0.063", "-0.063", "1.000", "1.000", "0.001", "-0.000", "0.000", "1.000", "123456.789", "—", "—", "—", "—"]


def test_scores_like_exact_decimals(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [math.sin(i) * (1 + i % 5) for i in range(500)] + [i / 16 for i in range(-50, 50)] + [i / 1000 + 0.0005 for i in range(200)]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(T.score_text("v").alias("s")).collect()]
    assert got == [("-" if v < 0 else "") + str(abs(Decimal(v)).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in values]


def test_names_and_sections(spark):
    r = one(
        spark,
        T.breadcrumb(F.array(F.lit("A"), F.lit("  "), F.lit("B"))).alias("crumbs"),
        T.shown_name(F.lit("a/.MD")).alias("bare"),
        T.shown_name(F.lit("a/B.Md")).alias("name"),
        T.has_section(F.lit("x\n## Y\n"), ["## Z", "## Y"]).alias("has"),
        T.has_section(F.lit(None).cast("string"), ["## Y"]).alias("none"),
        T.stamped_name("{{topic}} {{date}}{{time}}{{topic}}.md", F.lit("2024-02-03 04:05:06").cast("timestamp"), F.lit("{{time}}")).alias("stamped"),
    )
    assert (r.crumbs, r.bare, r.name, r.has, r.none) == ("A › B", "a/.MD", "B", True, False)
    assert r.stamped == "{{time}} 202402030405{{time}}.md"


def test_generated_maps_and_listing(spark):
    contents = ["---\ntype: moc\n---\nx", '---\na: 1\ntype: "moc"\n---\n', "---\ntype: mocs\n---\n", "type: moc", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string").select("i", N.is_generated_map("c").alias("g")).orderBy("i").collect()
    assert [r.g for r in rows] == [True, True, False, False, False]
    notes = spark.createDataFrame([(p,) for p in ("a.md", "A/É.md", "A/b/c.md", "A/x.txt", "root/y.md")], "path string")
    listed = lambda folder: sorted((r.path, r.key) for r in N.folder_listing(notes, folder).collect())
    assert listed("A/") == [("A/É.md", "a/é.md")]
    assert listed("") == [("a.md", "a.md")]
    assert listed("root") == [("root/y.md", "root/y.md")]


SOURCE = "struct<start_offset:long,end_offset:long,start_line:long,end_line:long>"


def test_chunk_contract(spark):
    notes = spark.createDataFrame([("a.md", "x😀y")], "path string, content string")
    schema = f"id string, path string, ordinal long, text string, content_hash string, heading_path array<string>, source {SOURCE}"
    good = ("i", "a.md", 0, "", "h", [], (0, 4, 0, 0))
    change = lambda at, value: (*good[:at], value, *good[at + 1 :])
    cases = {
        None: good, "id": change(0, None), "path": change(1, "b.md"), "ordinal": change(2, 2**53), "text": change(3, None), "hash": change(4, ""), "headings": change(5, ["a", None]),
    }
    for fault, row in cases.items():
        assert contract.checked(spark.createDataFrame([row], schema), notes).first().fault == fault
    for source in (None, (0, 5, 0, 0), (3, 2, 0, 0), (0, 1, 2, 1), (0, None, 0, 0), (-1, 0, 0, 0)):
        assert contract.checked(spark.createDataFrame([change(6, source)], schema), notes).first().fault == "source"
    assert contract.required(spark.createDataFrame([good], schema), notes).count() == 1
    with pytest.raises(Exception, match="rule on hash: a.md"):
        contract.required(spark.createDataFrame([change(4, "")], schema), notes).collect()


def test_answers_and_counters(spark):
    files = spark.createDataFrame([("a/b.c.md", 5, 0, 0, 7, "stale"), ("d.md", 6, 1, 0, 8, "fresh"), ("e.md", 6, 1, 0, 8, "unseen")], "path string, mtime long, n_links long, n_backlinks long, word_count long, state string")
    answers = spark.createDataFrame([("a/b.c.md", "polished", None), ("?", "draft", None), ("e.md", "draft", "timeout")], "path string, quality string, error string")
    rows = {r.path: r for r in audit.joined_answers(answers, files).collect()}
    assert (rows["a/b.c.md"].known, rows["a/b.c.md"].basename, rows["a/b.c.md"].orphan, rows["a/b.c.md"].word_count) == (True, "b.c", True, 7)
    assert (rows["?"].known, rows["?"].basename, rows["?"].orphan) == (False, None, None)
    assert audit.quality_counts(audit.joined_answers(answers, files)).first().asDict() == {"draft": 2, "developed": 0, "polished": 1, "orphans": 1}
    assert audit.audit_counters(files, answers).first().asDict() == {"total": 3, "processed": 1, "skipped": 1, "failed": 1}
    empty = audit.audit_counters(files.limit(0), answers.limit(0)).first().asDict()
    assert empty == {"total": 0, "processed": 0, "skipped": 0, "failed": 0}


def test_clusters_of_answers(spark):
    answers = [(1, 'x {"clusters": [{"name": " A ", "filePaths": ["p", "q"]}, {}]} y'), (2, "none"), (3, '{"clusters": null}'), (0, None)]
    part = audit.coerced_clusters(spark.createDataFrame(answers, "seq long, answer string"))
    rows = [tuple(r) for r in audit.joined_clusters([part.where("name = ''"), part]).orderBy("seq").collect()]
    a, b, top = (2**20, "A", "", "", ["p", "q"], 2), (2**20 + 1, "", "", "", [], 0), 2**50
    assert rows == [b, (a[0] + top, *a[1:]), (b[0] + top, *b[1:])]


def test_rewriting(spark):
    rows = [("x/a.md", "old a ", "Q::A", None), ("y/a.md", "old b", "nothing", None), ("c.md", "old c", None, None), ("d.md", "old d", "Q::A", "timeout")]
    answers = spark.createDataFrame(rows, "path string, content string, answer string, error string")
    plain = {r.path: r for r in rewrite.rewritten(answers, ".b").collect()}
    assert (plain["x/a.md"].content, plain["x/a.md"].backup, plain["x/a.md"].backup_path) == ("Q::A", "old a ", ".b/a.md")
    assert (plain["c.md"].content, plain["c.md"].error, plain["c.md"].backup_path) == ("old c", "no answer", None)
    cards = rewrite.rewritten(answers, ".b", append=True)
    found = {r.path: r for r in cards.collect()}
    assert found["x/a.md"].content == "old a\n\n## Flashcards\n#flashcards\n\nQ::A\n" and found["y/a.md"].error == "no flashcard was found"
    assert [tuple(r) for r in rewrite.backups(rewrite.rewritten(answers, ".b")).collect()] == [(".b/a.md", "old a ")]
    assert rewrite.report(cards, ".b").first().report == "# Batch report\n\nRewritten: 1\nFailed: 3\nBackups: .b\n\n## Errors\n- c.md: no answer\n- d.md: timeout\n- a.md: no flashcard was found"
    assert rewrite.report(cards.limit(0), ".b").first().report.endswith("Failed: 0\nBackups: .b")


def test_requests(spark):
    assert P.request_headers("ollama") == {"Content-Type": "application/json", "Authorization": "Bearer ollama"}
    assert P.request_headers("openrouter", "k", "https://example.com", "t") == {"Content-Type": "application/json", "Authorization": "Bearer k", "HTTP-Referer": "https://example.com", "X-Title": "t"}
    assert "Authorization" not in P.request_headers("openai-compatible", " ")
    body = json.loads(one(spark, P.request_bodies("ollama", "m", F.lit("s"), F.lit('u "x"'), stream=True).alias("b")).b)
    assert body == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": 'u "x"'}], "temperature": 0.7, "max_tokens": 2000, "stream": True}
    assert json.loads(one(spark, P.request_bodies("openrouter", "m", F.lit("s"), F.lit("u")).alias("b")).b)["repetition_penalty"] == 1.15


def test_clear_turns_automatic_sync_off(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "# A\n\nsome words")], "path string, content string")
    open_index = lambda: NoteIndex(GenerationStore(spark, str(tmp_path / "index"), "s", 64), P.HashedBow)
    batch = {"epoch": 0, "reconcile_all": True, "upserts": [], "deletes": []}
    read = lambda paths: notes
    index = open_index()
    index.clear()
    assert index.store.manifest() is None and index.flush(batch, read) is None
    index.update(notes, mode="reconcile")
    assert index.flush(batch, read) is not None
    index.clear()
    again = open_index()
    assert again.store.suspended() and again.flush(batch, read) is None and again.store.manifest().count == 0
    again.update(notes, mode="reconcile")
    assert not open_index().store.suspended() and again.store.manifest().count == 1


def test_clusters_are_replaced(spark, tmp_path):
    schema, at = "seq long, name string, description string, moc string, paths array<string>", str(tmp_path / "clusters")
    assert records.load_clusters(spark, at).count() == 0
    records.save_clusters(spark.createDataFrame([(1, "A", "", None, ["p", "q"]), (2, "B", "", None, [])], schema), at)
    assert sorted((r.seq, r.path, r.place) for r in records.load_clusters(spark, at).collect() if r.path) == [(1, "p", 0), (1, "q", 1)]
    records.save_clusters(spark.createDataFrame([(3, "C", "", None, ["r"])], schema), at)
    assert [(r.seq, r.path) for r in records.load_clusters(spark, at).collect()] == [(3, "r")]


def test_audit_canvas(spark):
    totals = spark.createDataFrame([(3, 1)], "total long, orphaned long")
    folders = spark.createDataFrame([("a", 1), ("b", 2)], "folder string, n long")
    canvas = json.loads(reports.audit_canvas(totals, folders, "2024-01-02", 'x"' * 501).first().canvas)
    texts = {n["id"]: n["text"] for n in canvas["nodes"]}
    assert texts["advice"] == "## Advice\n" + 'x"' * 500 + "..." and texts["folders"] == "## Folders\n- b\n- a"
    assert [e["toNode"] for e in canvas["edges"]] == ["stats", "folders", "advice"] and "color" not in canvas["nodes"][1]
    empty = json.loads(reports.audit_canvas(totals, folders.limit(0), "", "").first().canvas)
    assert [n["text"] for n in empty["nodes"]][2:] == ["## Advice\n", "## Folders\n"]

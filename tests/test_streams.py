"""Streams with state against the same over tables."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from loamdex.plans import progress
from loamdex.sources import note_sink, records, vault
from loamdex.sources.notes import normalized_events
from loamdex.streaming import debounce, pending, sync, token_state, tokens
from pyspark.sql import functions as F

EVENTS = "op string, path string, new_path string, ts timestamp, seq long, vault string"


def events_of(seed=4, n=260):
    """Bursts with renames, reconciles, other files and events at the very gap, and one that ends all."""
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(milliseconds=rng.choice((0, 1, 100, 700, 1499, 1500, 1501, 4000, 90_000)))
        path = f"n{rng.randrange(6)}{rng.choice(('.md', '.md', '.md', '.txt'))}"
        op = rng.choice(("create", "modify", "modify", "delete", "rename", "rename", *(["reconcile"] if i % 9 == 0 else [])))
        rows.append((op, path, f"m{rng.randrange(6)}{rng.choice(('.md', '.txt'))}" if op == "rename" else None, at, i, rng.choice("ab")))
    return [*rows, *(("create", "end.md", None, at + timedelta(hours=9), n + k, v) for k, v in enumerate("ab"))]


def test_debounced_stream_is_the_table(spark, tmp_path):
    """Three runs from one checkpoint, events out of order within the watermark's bound."""
    rows, source, sink, point = events_of(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    cuts = [0, 90, 180, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        if b < len(rows):
            # the next run's first events are older than this one's last
            part = part[:-4] + [rows[b]]
        if a:
            part = rows[a - 4 : a] + [r for r in part if r != rows[a]]
        random.Random(a).shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = debounce.debounced(spark.readStream.schema(EVENTS).parquet(source), late="1 hour")
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(sink).collect()
    assert not any(r.path == "end.md" for r in got) and any(r.reconcile_all for r in got)
    for vault in "ab":
        table = spark.createDataFrame([r for r in rows if r[-1] == vault], EVENTS)
        want = [(r.session, r.reconcile_all, r.path, r.op) for r in sync.sync_batches(table.drop("vault")).collect() if r.path != "end.md"]
        mine = [(r.session, r.reconcile_all, r.path, r.op) for r in got if r.vault == vault]
        assert sorted(mine, key=str) == sorted(want, key=str)


def test_paths_of_one_vault_are_dealt_out(spark, tmp_path):
    """many paths in one vault with batches that end all the time; more than one task puts them out."""
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    rows = [(("modify", "delete", "create")[i % 3], f"n{i * 7 % 90}.md", None, at(i * 40 + i // 50 * 1460 + i // 200), i, "") for i in range(600)]
    rows += [("reconcile", None, None, at(6000), 600, ""), ("create", "end.md", None, at(10**8), 601, "")]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(source)
    stream = debounce.debounced(spark.readStream.schema(EVENTS).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(sink)
    want = sync.sync_batches(spark.createDataFrame(rows, EVENTS).drop("vault")).where("path IS NULL OR path <> 'end.md'")
    mine = [(r.session, r.reconcile_all, r.path, r.op) for r in got.collect()]
    assert sorted(mine, key=str) == sorted(((r.session, r.reconcile_all, r.path, r.op) for r in want.collect()), key=str)
    assert len({m[0] for m in mine}) > 1 and sum(m[1] for m in mine) == 1
    assert got.where("path IS NOT NULL").select(F.input_file_name()).distinct().count() > 1


def test_other_files_hold_no_batch_open(spark):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    rows = [("create", "a.md", None, at(0), 0, ""), ("create", "x.txt", None, at(1000), 1, ""), ("create", "b.md", None, at(2000), 2, "")]
    got = sync.sync_batches(spark.createDataFrame(rows, EVENTS).drop("vault")).orderBy("session").collect()
    assert [(r.session, r.path) for r in got] == [(1, "a.md"), (2, "b.md")]
    assert normalized_events(spark.createDataFrame(rows, EVENTS)).count() == 2


# the durable log

CHANGES = "op string, path string, new_path string, ts timestamp, seq long"


def put(spark, source, *ops):
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(op, path, None, at, i) for i, (op, path) in enumerate(ops)], CHANGES).coalesce(1).write.mode("append").parquet(source)


def test_nothing_pending_is_lost(spark, tmp_path):
    source, point, root, flushed = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "log"), []

    def run(flush, **options):
        log = pending.PendingLog(spark, root, flush, **options)
        pending.follow_durably(spark.readStream.schema(CHANGES).parquet(source), log, point, availableNow=True).awaitTermination(120)
        return log

    def fails(ops, reconcile, guard):
        raise RuntimeError("provider")

    def works(ops, reconcile, guard):
        flushed.append((sorted(tuple(r) for r in ops.collect()), reconcile, guard()))

    seen = []
    put(spark, source, ("create", "a.md"), ("create", "b.md"), ("delete", "c.md"))
    log = run(fails, on_error=seen.append)
    assert len(seen) == 1 and sorted(r.path for r in log.pending().collect()) == ["a.md", "b.md", "c.md"]
    # a driver that dies after the log was written: the micro-batch comes again
    put(spark, source, ("delete", "a.md"), ("create", "d.md"))

    class Killed(pending.PendingLog):
        def run(self):
            raise SystemError("killed")

    with pytest.raises(Exception, match="killed"):
        pending.follow_durably(spark.readStream.schema(CHANGES).parquet(source), Killed(spark, root, works), point, availableNow=True).awaitTermination(120)
    log = run(works)
    assert flushed == [([("a.md", "delete"), ("b.md", "upsert"), ("c.md", "delete"), ("d.md", "upsert")], False, True)] and log.pending().count() == 0 and not log.run()
    # a reconcile stands for everything, and a failed one comes again
    put(spark, source, ("create", "e.md"), ("reconcile", None))
    run(fails)
    put(spark, source, ("create", "f.md"))
    run(works)
    assert flushed[1:] == [([], True, True)]
    # no first index by itself, a pause, a new epoch
    put(spark, source, ("create", "g.md"))
    log = run(works, has_index=lambda: False)
    log.has_index = lambda: True
    log.reconfigure(paused=True)
    assert not log.run() and len(flushed) == 2
    log.reconfigure(paused=False)
    log.flush = lambda ops, reconcile, guard: log.reconfigure(paused=False) or flushed.append(guard())
    assert not log.run() and flushed[-1] is False and log.pending().count() == 1
    log.flush = works
    assert log.run() and flushed[-1][0] == [("g.md", "upsert")]
    log.reconfigure(paused=False, keep=False, reconcile=True)
    assert log.run() and flushed[-1] == ([], True, True)


# token streams


def delta(text, **more):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}, **more}]}) + "\n"


STREAMS = {
    1: ([delta("Hel"), delta("lo"), ": note\n", "data: {oops\n", "data: [DONE]\n", delta("x")], "Hello", 2, "done"),
    2: ([delta("a"), delta("b", finish_reason="stop"), delta("c")], "a", 1, "finish"),
    3: ([delta("a", finish_reason="null"), delta("", finish_reason=None), delta("b").rstrip("\n") + " \r\n", delta(3), "data:" + delta("z")[6:], delta("last")[:-1]], "ab", 2, "end"),
    4: ([delta("0123456789abcdefghij" * 5)] * 9, "0123456789abcdefghij" * 15, 3, "loop"),
    5: (["\n\n"], "", 0, "end"),
    6: ([delta("é" * i) for i in range(1, 30)] + [delta("\n")] * 5, None, 0, None),
}


def folded(text):
    """The stream's rules, one line after the other."""
    said, n = "", 0
    for line in text.split("\n")[:-1]:
        line = line.strip()
        if not line.startswith("data: "):
            continue
        if line[6:] == "[DONE]":
            return said, n, "done"
        try:
            choice = json.loads(line[6:])["choices"][0]
        except ValueError:
            continue
        piece = choice["delta"].get("content", "")
        if not isinstance(piece, str):
            continue
        if choice.get("finish_reason") not in (None, "", "null"):
            return said, n, "finish"
        if not piece:
            continue
        tail = (said + piece)[-600:]
        if len(said + piece) >= 400 and any(len(tail[-k:].strip()) >= 10 and len(tail) >= 3 * k and tail[-k:] == tail[-2 * k : -k] == tail[-3 * k : -2 * k] for k in range(20, 101, 10)):
            return said, n, "loop"
        said, n = said + piece, n + 1
    return said, n, "end"


@pytest.mark.parametrize("size", [3, 1000])
def test_token_streams(spark, size):
    rows = []
    for response, (parts, *_) in STREAMS.items():
        text = "".join(parts)
        rows += [(response, i, text[i : i + size]) for i in range(0, len(text), size)]
    random.Random(1).shuffle(rows)
    got = {r.response: (r.text, r.n_pieces, r.ended) for r in tokens.texts(spark.createDataFrame([*rows, (7, 0, None)], "response int, seq int, fragment string").repartition(3)).collect()}
    assert got == {k: folded("".join(parts)) for k, (parts, *_) in STREAMS.items()} | {7: ("", 0, "end")}
    assert all(got[k] == tuple(want) for k, (_, *want) in STREAMS.items() if want[0] is not None)


def test_token_streams_with_state(spark, tmp_path):
    """Two runs from one checkpoint; fragments out of order in each, and one that comes a run late."""
    source, sink, point, rows = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), []
    schema = "response string, seq long, fragment string"
    for response, (parts, *_) in STREAMS.items():
        text = "".join(parts)
        rows += [(str(response), i, text[i * 37 : i * 37 + 37]) for i in range(-(-len(text) // 37))]
    random.Random(1).shuffle(rows)
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = token_state.shown_stream(spark.readStream.schema(schema).parquet(source), None)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination(120)
    key = lambda r: (str(r.response), r.line, r.piece or "", r.ended or "")
    want = tokens.shown(tokens.pieces(tokens.lines(spark.createDataFrame(rows, schema)))).collect()
    assert sorted(map(key, spark.read.parquet(sink).collect())) == sorted(map(key, want))


def test_a_response_that_stands_still_times_out(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 0, delta("x")), ("b", 0, "data: [DONE]\n"), ("c", 1, delta("y"))], "response string, seq long, fragment string").coalesce(1).write.parquet(source)
    stream = token_state.shown_stream(spark.readStream.schema("response string, seq long, fragment string").parquet(source), 0.5)
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(1)
        got = sorted((r.response, r.piece or "", r.ended or "") for r in spark.read.schema(token_state.SHOWN).parquet(sink).collect()) if (tmp_path / "out" / "_spark_metadata").exists() else []
        if len(got) >= 4:
            break
    query.stop()
    assert got == [("a", "", "timeout"), ("a", "x", ""), ("b", "", "done"), ("c", "", "timeout")]


# files


def test_notes_are_written_with_backups(spark, tmp_path):
    root = str(tmp_path / "vault")
    (tmp_path / "vault" / "d").mkdir(parents=True)
    (tmp_path / "vault" / "d" / "a.md").write_text("old")
    (tmp_path / "vault" / "bad.md").mkdir()
    rows = [("d/a.md", "new", ".backup/a.md", "old", None), ("new/b.md", "bé", None, None, None), ("../c.md", "x", None, None, None), ("bad.md", "x", None, None, None), ("e.md", "x", None, None, "timeout"), ("f.md", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, content string, backup_path string, backup string, error string").repartition(3)
    first = {r.path: (r.state, r.error) for r in note_sink.write_notes(df, root).collect()}
    assert first["bad.md"][0] == "failed" and first["bad.md"][1] and {k: v for k, v in first.items() if k != "bad.md"} == {
        "d/a.md": ("written", None), "new/b.md": ("written", None), "../c.md": ("failed", "a path isn't canonical"), "e.md": ("failed", "timeout"), "f.md": ("failed", "no content"),
    }
    assert (tmp_path / "vault/d/a.md").read_text() == "new" and (tmp_path / "vault/.backup/a.md").read_text() == "old" and (tmp_path / "vault/new/b.md").read_text() == "bé"
    again = df.withColumn("backup", F.when(F.col("path") == "d/a.md", "new"))
    assert {r.path: r.state for r in note_sink.write_notes(again, f"file://{root}").collect()}["d/a.md"] == "unchanged"
    assert (tmp_path / "vault/.backup/a.md").read_text() == "old" and not list(tmp_path.glob("vault/**/*.tmp"))


def test_a_killed_task_leaves_old_or_new(spark, tmp_path, monkeypatch):
    root, files = str(tmp_path), note_sink.fs.LocalFileSystem()
    (tmp_path / "a.md").write_text("old")
    row, puts = {"path": "a.md", "content": "new", "backup_path": "b/a.md", "backup": "old"}, note_sink._put

    def dies(at):
        calls = iter(range(9))

        def put_or_die(*args):
            if next(calls) == at:
                raise KeyboardInterrupt
            puts(*args)

        return put_or_die

    for at, backup in ((0, False), (1, True)):
        monkeypatch.setattr(note_sink, "_put", dies(at))
        with pytest.raises(KeyboardInterrupt):
            note_sink._save(files, root, row)
        assert (tmp_path / "a.md").read_text() == "old" and (tmp_path / "b/a.md").exists() == backup
    monkeypatch.setattr(note_sink, "_put", puts)
    assert note_sink._save(files, root, row) == "written" and (tmp_path / "b/a.md").read_text() == "old"


def test_vault_source(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "d").mkdir(parents=True)
    for path, text in (("a.md", "A"), ("d/b.MD", "B é"), ("d/c.txt", "no"), ("d/d.md", "")):
        (root / path).write_text(text)
    spark.dataSource.register(vault.VaultSource)
    notes = spark.read.format("vault").option("path", str(root)).option("bytes", 1).load()
    assert sorted((r.path, r.content) for r in notes.collect()) == [("a.md", "A"), ("d/b.MD", "B é"), ("d/d.md", "")] and notes.first().mtime > 10**12
    (root / "a.md").write_bytes(b"\xff")  # no text: whoever opens it fails
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("vault").option("path", str(root)).option("filters", "true").load().where("path LIKE 'd/%' AND content <> ''")
        assert [r.path for r in some.collect()] == ["d/b.MD"]
        assert spark.read.format("vault").schema("path string").option("path", str(root)).load().count() == 3
        with pytest.raises(Exception, match="decode"):
            notes.collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_vault_changes(spark, tmp_path):
    root, sink, point = tmp_path / "vault", str(tmp_path / "out"), str(tmp_path / "ck")
    root.mkdir()
    spark.dataSource.register(vault.VaultSource)

    def run():
        stream = spark.readStream.format("vault").option("path", str(root)).option("changes", "true").load()
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.op, r.path or "") for r in spark.read.parquet(sink).collect())

    (root / "a.md").write_text("A")
    time.sleep(0.1)
    assert run() == [("modify", "a.md"), ("reconcile", "")]
    (root / "b.md").write_text("B")
    (root / "c.txt").write_text("C")
    time.sleep(0.1)
    assert run() == [("modify", "a.md"), ("modify", "b.md"), ("reconcile", "")]


def test_records_survive_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "records")
    row = spark.createDataFrame([("a.md", 1, 2, "i", [], [], "good", [], 3, None, None, None, None)], records.SCHEMA)
    records.save_records(row, path)
    monkeypatch.setattr(records.SharedFolder, "replace", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        records.save_records(row.union(row), path)
    assert records.load_records(spark, path).count() == 1


def test_progress_of_a_stream(spark, tmp_path):
    source, told = str(tmp_path / "in"), []
    put(spark, source, ("create", "a.md"), ("create", "b.md"))
    listener = progress.StreamProgress("watched", told.append)
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(CHANGES).parquet(source)
        rows.writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(100):
            if told and "error" in told[-1]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t["rows"] for t in told if "rows" in t] == [2] and told[-1] == {"error": None}

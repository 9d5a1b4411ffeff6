"""Running sums over a global order, free names, ordered text, packing and where new notes go, each against a plain fold."""

import random
import unicodedata

import pytest
from loamdex.functions import text as T
from loamdex.operators import audit, names, ordered
from loamdex.plans import reports
from loamdex.streaming import sync
from pyspark.sql import functions as F


@pytest.mark.parametrize("parts", [1, 5])
def test_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("aaab") if i % 9 else None, rng.randrange(400), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, a int, b int, n long").repartition(3)
    got = {r.b: r.before for r in ordered.running(df, F.struct("a", "b"), F.col("n"), parts=parts).collect()}
    by = {r.b: r.before for r in ordered.running(df, F.struct("a", "b"), F.col("n"), by=("k",), parts=parts).collect()}
    total, each = 0, {}
    for k, _, b, n in sorted(rows, key=lambda r: r[1:3]):
        assert got[b] == total and by[b] == each.get(k, 0)
        total, each[k] = total + n, each.get(k, 0) + n
    parted = ordered.parted(df, F.struct("a", "b"), parts=parts).groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).orderBy("part").collect()
    assert all(x.hi < y.lo for x, y in zip(parted, parted[1:])) and (parts == 1 or max(r.n for r in parted) < 500 / parts * 2.5)


def test_running_over_nothing_and_nulls(spark):
    assert ordered.running(spark.createDataFrame([], "a int"), F.col("a"), F.lit(1)).count() == 0
    rows = spark.createDataFrame([(None,), (2,), (1,)], "a int")
    assert sorted((r.before, r.a) for r in ordered.running(rows, F.col("a"), F.lit(1)).collect() if r.a) == [(1, 1), (2, 2)]


def one_by_one(wanted, taken):
    key = lambda x: unicodedata.normalize("NFC", x).lower()
    used, out = {key(t) for t in taken}, []
    for name in wanted:
        new, n = name, 2
        while key(new) in used:
            new, n = f"{name}-{n}", n + 1
        used.add(key(new))
        out.append(new)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_free_names_are_given_out_one_by_one(spark, seed):
    """10,000 names that clash, also with each other's numbered forms."""
    rng = random.Random(seed)
    pool = ["a", "A", "a-2", "a-2-2", "a-10", "b", "b-02", "b-1", "MOC", "été", "ÉTÉ", "x y", "-2", "c-3", *(f"n{i}" for i in range(300))]
    wanted = [rng.choice(pool[:14] if rng.random() < 0.7 else pool) for _ in range(10_000 if seed == 0 else 500)]
    taken = [rng.choice(["a", "a-2", "b-3", "B-5", "moc", "moc-2", "moc-4", "x y-2", "x y-02", "n7-2", "n8", "c-3-2", "zz"]) for _ in range(15)] + [f"moc-{i}" for i in range(20, 900, 3)]
    df = spark.createDataFrame(list(enumerate(wanted)), "seq long, name string").repartition(5)
    got = names.free_names(df, spark.createDataFrame([(t,) for t in taken], "name string")).orderBy("seq").collect()
    assert [r.free for r in got] == one_by_one(wanted, taken)


def test_free_names_of_nothing(spark):
    none = spark.createDataFrame([], "seq long, name string")
    assert names.free_names(none).count() == 0
    assert [tuple(r) for r in names.free_names(spark.createDataFrame([(1, None), (2, "a")], "seq long, name string")).orderBy("seq").collect()] == [(1, None, None), (2, "a", "a")]


@pytest.mark.parametrize("limit", [0, 50, 10_000])
def test_text_is_cut(spark, limit):
    lines = {f"p{i:03}": "é" * (i % 7) for i in range(100)}
    df = spark.createDataFrame(list(lines.items()), "p string, line string").repartition(4)
    text = "\n".join(lines[k] for k in sorted(lines))
    want = text if len(text) <= limit else text[:limit] + "[cut]"
    assert ordered.text_up_to(df, F.col("p"), F.col("line"), limit, "[cut]").first().text == want


@pytest.mark.parametrize("seed", range(3))
def test_exits_are_folds(seed):
    rng = random.Random(seed)
    for _ in range(50):
        sizes, after = [rng.randrange(60) for _ in range(rng.randrange(12))], [rng.randrange(60) for _ in range(4)]
        folds = audit.Exits(4, 100)
        for at in range(0, len(sizes), 3):
            folds.take(sizes[at : at + 3])
        for entry, (leaves, begun) in enumerate(folds.result(after)):
            if entry >= len(sizes):
                assert (leaves, begun) == (entry - len(sizes), 0)
                continue
            opens, state = audit.fold_batches(sizes[entry:], (0, 0), 4, 100)
            taken = audit.fold_batches(after, state, 4, 100)[0]
            assert (leaves, begun) == (taken.index(True) if True in taken else len(taken), 1 + sum(opens))


def test_sessions_lie_in_even_slices(spark):
    """Events in a few bursts far apart: slices go by counts, not by time."""
    rng = random.Random(2)
    times = sorted(b * 10**9 + rng.randrange(200_000) for b in (0, 1, 500) for _ in range(300))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, ms long").select("seq", F.timestamp_millis("ms").alias("ts")).repartition(3)
    got = [r.session for r in sync.sessions(df, 1500).orderBy("seq").collect()]
    want, n = [], 0
    for i, t in enumerate(times):
        n += i == 0 or t - times[i - 1] > 1500
        want.append(n)
    assert got == want
    parts = ordered.parted(df, F.struct("ts", "seq"), parts=8).groupBy("part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 300


CLUSTERS = [(1, " Topic ", " About ", ["a/x.md", "y.md"], "Map of it"), (2, None, None, None, None), (3, "topic", "b", [], None), (4, "", "c", ["z.md"], None), (5, "Mine", "d", [], None), (6, "Old/one", "e", [], None)]


def test_map_notes_are_named_after_clusters(spark):
    clusters = spark.createDataFrame(CLUSTERS, "seq long, name string, description string, paths array<string>, moc string")
    generated, own = "---\ntype: moc\n---\n\n# Old", "# By hand"
    notes = spark.createDataFrame([("MOCs/Mine.md", own), ("MOCs/Old one.md", generated), ("MOCs/sub/Topic.md", own), ("MOCs/moc.md", generated), ("Topic.md", own)], "path string, content string")
    got = {r.seq: r for r in reports.placed_mocs(clusters, notes).collect()}
    assert {k: (r.path, r.overwrites) for k, r in got.items()} == {
        1: ("MOCs/Topic.md", False), 2: ("MOCs/moc.md", True), 3: ("MOCs/topic-2.md", False), 4: ("MOCs/MOC-2.md", False), 5: ("MOCs/Mine-2.md", False), 6: ("MOCs/Old one.md", True),
    }
    assert got[1].content == "---\ntype: moc\n---\n\n# Topic\n\nAbout\n\n## Notes (2)\n\n- [[a/x|x]]\n- [[y]]\n"
    assert got[2].content == "---\ntype: moc\n---\n\n# MOC\n\n\n\n## Notes (0)\n\n\n"


def test_undescribed_clusters_ask_a_model(spark):
    class Model:
        def complete(self, system, user):
            if "Bad" in user:
                raise ValueError("no")
            return f" told {user.split()[0]} "

    clusters = spark.createDataFrame([(1, "Good", " ", ["p"]), (2, "Has", "own", []), (3, "Bad", None, None)], "seq long, name string, description string, paths array<string>")
    got = [(r.description, r.error is None) for r in reports.described(clusters, lambda: Model(), "s").orderBy("seq").collect()]
    assert got[:2] == [("told Good", True), ("own", True)] and got[2][1] is False


def test_atoms_and_their_section(spark):
    answer = '{"atoms": [{"title": " One\\n two ", "body": " b "}, {"title": "", "body": "x"}, {"title": "??", "body": "y"}, {"title": "One two", "body": "z"}]}'
    rows = [("d/n.md", "text  \n", answer), ("m.md", "t", '[{"title": "One two", "body": "q"}]'), ("d/has.md", "x\n## Atomic notes\n", answer), ("bad.md", "t", "sorry")]
    notes = spark.createDataFrame(rows, "path string, content string, answer string")
    made = reports.atoms(notes, spark.createDataFrame([("d/Atom.md",)], "path string"))
    got = [(r.source, r.path, r.content.split("# ", 1)[1]) for r in made.orderBy("seq").collect()]
    assert got == [("d/n.md", "d/One two.md", "One two\n\nb\n"), ("d/n.md", "d/Atom-2.md", "??\n\ny\n"), ("d/n.md", "d/One two-2.md", "One two\n\nz\n"), ("m.md", "One two.md", "One two\n\nq\n")]
    linked = {r.path: r.content for r in reports.linked_originals(notes, made).collect()}
    assert linked == {"d/n.md": "text\n\n## Atomic notes\n\n- [[d/One two|One two]]\n- [[d/Atom-2|Atom-2]]\n- [[d/One two-2|One two-2]]\n", "m.md": "t\n\n## Atomic notes\n\n- [[One two]]\n"}
    assert {r.path for r in reports.atoms(notes, folder="Atoms").collect()} == {"Atoms/One two.md", "Atoms/Atom.md", "Atoms/One two-2.md", "Atoms/One two-3.md"}
    assert T.has_section

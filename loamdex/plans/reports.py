"""Reports and canvases, as one-row tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import names, ordered
from ..operators.audit import js_round
from ..sources import notes as N

SNAPSHOT_CHARS, CLUSTER_LINKS, CANVAS_LINKS, RADIUS = 300_000, 20, 10, 700


def snapshot_text(notes: DataFrame, limit: int = SNAPSHOT_CHARS) -> DataFrame:
    """(snapshot): a line per note in path order, cut at ``limit`` characters with a mark."""
    line = F.concat(F.col("path"), F.lit(" | "), F.array_join("tags", " "), F.lit(" | "), F.col("n_links").cast("string"))
    return ordered.text_up_to(notes, F.col("path"), line, limit, "\n[cut]").withColumnRenamed("text", "snapshot")


def dashboard(totals: DataFrame, folders: DataFrame, tags: DataFrame) -> DataFrame:
    """(report): Markdown of an audit's totals with the largest folders and tags."""
    listed = lambda df, key: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), key, "n"))), lambda x: F.concat(F.lit("- "), x[key], F.lit(": "), x["n"].cast("string"))), "\n").alias(key))
    one = totals.crossJoin(listed(folders, "folder")).crossJoin(listed(tags, "tag"))  # one row each
    health = F.when(F.col("ill_linked"), "poor").otherwise("good")
    return one.select(F.concat_ws("\n", F.lit("# Vault audit"), F.format_string("Notes: %d, tagged: %d, orphaned: %d, connected: %d%%", "total", "with_tags", "orphaned", "connectivity"), F.concat(F.lit("Health: "), health), F.lit("## Folders"), F.col("folder"), F.lit("## Tags"), F.col("tag")).alias("report"))


def cluster_report(clusters: DataFrame) -> DataFrame:
    """(seq, section): one Markdown section per cluster, at most 20 links and how many more there are."""
    links = F.transform(F.slice("paths", 1, CLUSTER_LINKS), lambda p: F.concat(F.lit("- "), T.wiki_link(p)))
    more = F.when(F.size("paths") > CLUSTER_LINKS, F.concat(F.lit("- …and "), (F.size("paths") - CLUSTER_LINKS).cast("string"), F.lit(" more")))
    return clusters.select("seq", F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("name", F.lit("Untitled"))), F.col("description"), F.array_join(links, "\n"), more).alias("section"))


def cluster_canvas(clusters: DataFrame) -> DataFrame:
    """(id, text, x, y, width, height, color) of each cluster's node on a circle; clusters: number ``i`` from 0 and ``total``."""
    angle = F.col("i") * 2 * F.pi() / F.col("total")
    links = F.array_join(F.transform(F.slice("paths", 1, CANVAS_LINKS), T.wiki_link), "\n")
    return clusters.select(
        F.concat(F.lit("cluster-"), F.col("i").cast("string")).alias("id"), F.concat_ws("\n", F.concat(F.lit("## "), F.col("name")), links).alias("text"),
        (js_round(F.cos(angle) * RADIUS) - 175).alias("x"), (js_round(F.sin(angle) * RADIUS) - 125).alias("y"), F.lit(350).alias("width"), F.lit(250).alias("height"),
        (F.col("i") % 6 + 1).cast("string").alias("color"),
    )


def canvas_json(nodes: DataFrame) -> DataFrame:
    """(canvas): nodes around a centre, each joined to it, as one JSON text."""
    centre = F.struct(F.lit("centre").alias("id"), F.lit("# Map").alias("text"), F.lit(-175).cast("long").alias("x"), F.lit(-125).cast("long").alias("y"), F.lit(350).alias("width"), F.lit(250).alias("height"), F.lit("0").alias("color"))
    all_nodes = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "text", "x", "y", "width", "height", "color"))).alias("n"))
    edges = F.transform("n", lambda n: F.struct(F.concat(F.lit("edge-"), n["id"]).alias("id"), F.lit("centre").alias("fromNode"), n["id"].alias("toNode")))
    return all_nodes.select(F.to_json(F.struct(F.concat(F.array(centre), F.col("n")).alias("nodes"), edges.alias("edges"))).alias("canvas"))


ADVICE_CHARS = 1000
#: id, x, y, width, height and color of an audit canvas' four nodes, and how the last three hang on the first.
AUDIT_NODES = (("center", 0, 0, 400, 200, "1"), ("stats", -450, -100, 300, 200, None), ("advice", 0, 250, 850, 400, None), ("folders", 450, -100, 300, 200, None))
AUDIT_EDGES = (("e1", "left", "stats", "right"), ("e2", "right", "folders", "left"), ("e3", "bottom", "advice", "top"))


def audit_canvas(totals: DataFrame, folders: DataFrame, day: str, advice: str) -> DataFrame:
    """(canvas): an audit's day, totals, advice (cut at 1000 characters) and largest folders as one JSON text.

    totals: one row; folders: (folder, n), already limited to the few that are shown.
    """
    listed = folders.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "folder"))), lambda x: F.concat(F.lit("- "), x["folder"])), "\n").alias("listed"))
    shown = advice[:ADVICE_CHARS] + ("..." if len(advice) > ADVICE_CHARS else "")
    texts = {
        "center": F.lit(f"# Vault audit\n{day}"),
        "stats": F.format_string("## Totals\nNotes: %d\nOrphaned: %d", "total", "orphaned"),
        "advice": F.lit(f"## Advice\n{shown}"),
        "folders": F.concat(F.lit("## Folders\n"), F.col("listed")),
    }
    nodes = [
        F.struct(F.lit(name).alias("id"), F.lit("text").alias("type"), texts[name].alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(color).cast("string").alias("color"))
        for name, x, y, width, height, color in AUDIT_NODES
    ]
    edges = [F.struct(F.lit(name).alias("id"), F.lit("center").alias("fromNode"), F.lit(side).alias("fromSide"), F.lit(to).alias("toNode"), F.lit(end).alias("toSide")) for name, side, to, end in AUDIT_EDGES]
    one = totals.crossJoin(listed)  # one row each
    return one.select(F.to_json(F.struct(F.array(*nodes).alias("nodes"), F.array(*edges).alias("edges"))).alias("canvas"))


def described(clusters: DataFrame, model: Callable[[], P.LanguageModel], system: str, files: int = 30) -> DataFrame:
    """clusters with ``error``; those without a description get a model's, from their name and first paths. A failed call leaves its cluster undescribed."""
    blank = T.trim_blank(F.coalesce("description", F.lit(""))) == ""
    asked = F.concat_ws("\n", F.coalesce("name", F.lit("")), F.array_join(F.slice(F.coalesce("paths", F.array().cast("array<string>")), 1, files), "\n"))
    told = P.completed(clusters.where(blank).withColumn("_asked", asked), model, system, "_asked").withColumn("description", T.trim_blank("answer")).drop("_asked", "answer")
    return clusters.where(~blank).withColumn("error", F.lit(None).cast("string")).unionByName(told.select(*clusters.columns, "error"))


def moc_notes(clusters: DataFrame, date: str = "") -> DataFrame:
    """(seq, file_name, content) of a map note per cluster, named after it (without a name: MOC); names still have to be made free, see ``placed_mocs``.

    clusters: (seq, name, description, paths). date: for the frontmatter, if given.
    """
    name, paths = T.trim_blank(F.coalesce("name", F.lit(""))), F.coalesce("paths", F.array().cast("array<string>"))
    base = F.coalesce(F.nullif(T.file_name(name), F.lit("")), F.lit("MOC"))
    links = F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), T.wiki_link(p))), "\n")
    head = "---\ntype: moc\n" + (f"date: {date}\n" if date else "") + "---\n\n# "
    content = F.concat(F.lit(head), F.coalesce(F.nullif(name, F.lit("")), base), F.lit("\n\n"), T.trim_blank(F.coalesce("description", F.lit(""))), F.lit("\n\n## Notes ("), F.size(paths).cast("string"), F.lit(")\n\n"), links, F.lit("\n"))
    return clusters.select("seq", base.alias("file_name"), content.alias("content"))


def placed_mocs(clusters: DataFrame, notes: DataFrame, folder: str = "MOCs", date: str = "") -> DataFrame:
    """(seq, path, content, overwrites): where each cluster's map note goes in the folder.

    notes: (path, content) of the collection. A map note that was generated earlier is
    written over; any other note keeps its name, and the new one gets a number.
    """
    here = N.folder_listing(notes, folder)
    named = lambda path: F.regexp_replace(path, r"\.md$", "")
    taken = here.where(~N.is_generated_map("content")).select(named("path").alias("name"))
    mocs = moc_notes(clusters, date).withColumn("name", F.concat(F.lit(folder.strip("/") + "/" if folder.strip("/") else ""), "file_name"))
    placed = names.free_names(mocs, taken).withColumn("path", F.concat("free", F.lit(".md"))).withColumn("_key", P.path_key("path"))
    known = here.select(F.col("key").alias("_key"), F.col("path").alias("_old")).groupBy("_key").agg(F.min("_old").alias("_old"))
    # the older spelling of a path stays
    return placed.join(known, "_key", "left").select("seq", F.coalesce("_old", "path").alias("path"), "content", F.col("_old").isNotNull().alias("overwrites"))


ATOMS = "array<struct<title:string,body:string>>"
ATOM_HEADINGS = ("## Atomic notes", "## Atomare Notizen")


def atoms(notes: DataFrame, existing: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """(source, seq, path, content) of atomic notes in models' answers; source: the note they come from, seq: their order.

    notes: (path, content, answer), each path once. An answer is a list of titles and bodies, or holds one as
    ``atoms``; blank ones are left out, as are notes that have their section of atoms already. The
    new notes lie beside their source or in ``folder``, under names that neither
    ``existing`` notes (path) nor each other have, given out by source and place.
    """
    todo = notes.where(~T.has_section("content", list(ATOM_HEADINGS))).select("path", T.extracted_json("answer").alias("json"))
    is_list = F.col("json").startswith("[")
    listed = F.when(is_list, F.from_json("json", ATOMS)).otherwise(F.from_json("json", f"atoms {ATOMS}")["atoms"])
    rows = todo.select("path", F.posexplode(listed).alias("place", "a"))
    rows = rows.select(F.col("path").alias("source"), "place", T.collapse_blank(F.coalesce("a.title", F.lit(""))).alias("title"), T.trim_blank(F.coalesce("a.body", F.lit(""))).alias("body")).where("title <> '' AND body <> ''")
    rows = rows.withColumn("seq", F.struct("source", "place"))
    base = F.coalesce(F.nullif(T.file_name("title"), F.lit("")), F.lit("Atom"))
    parent = F.regexp_extract("source", r"^(.*/)[^/]*$", 1) if folder is None else F.lit(folder.strip("/") + "/" if folder.strip("/") else "")
    wanted = rows.withColumn("name", F.concat(parent, base))
    taken = None if existing is None else existing.select(F.regexp_replace("path", r"\.md$", "").alias("name"))
    content = F.concat(F.lit("---\ntype: atom\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return names.free_names(wanted, taken).select("source", "seq", F.concat("free", F.lit(".md")).alias("path"), content.alias("content"))


def linked_originals(notes: DataFrame, made: DataFrame) -> DataFrame:
    """(path, content) of the notes that atoms were made of, with a section of links to them; made: (source, seq, path) of those that could be written."""
    links = made.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: F.concat(F.lit("- "), T.wiki_link(x["path"]))), "\n").alias("links"))
    both = notes.join(links, notes["path"] == links["source"]).where(~T.has_section("content", list(ATOM_HEADINGS)))
    return both.select("path", T.append_section("content", F.concat(F.lit(ATOM_HEADINGS[0] + "\n\n"), "links")).alias("content"))

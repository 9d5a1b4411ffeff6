"""Notes and what hangs on them: vault scans, links, tags, events, and the notes the test tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import text as T


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, mtime) of all Markdown files below a folder; an unreadable one fails the whole read."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[mM][dD]")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.element_at(F.split(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), base, 2), -1)
    return files.select(path.alias("path"), F.col("value").alias("content"), F.unix_millis("_metadata.file_modification_time").alias("mtime"))


def read_paths(notes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes found, paths missing) for distinct requested paths; others than Markdown count as missing."""
    wanted = wanted.select("path").distinct()
    found = notes.where(T.is_markdown("path")).join(wanted, "path", "left_semi")
    return found, wanted.join(notes.where(T.is_markdown("path")).select("path"), "path", "left_anti")


def folder_listing(notes: DataFrame, folder: str = "") -> DataFrame:
    """Notes right inside a folder (empty: the top), with ``key``: the path as file systems without case compare it."""
    from ..functions.providers import path_key

    here = folder.strip("/") or "root"
    inside = (T.parent_folder("path") == here) & (F.contains("path", F.lit("/")) if folder.strip("/") else ~F.contains("path", F.lit("/")))
    return notes.where(inside & F.col("path").endswith(".md")).withColumn("key", path_key("path"))


FRONT = r"^\x{FEFF}?---\r?\n((?s:.*?\n)?)---(?:\r?\n|$)"


def frontmatter(content: str | F.Column) -> F.Column:
    """The block between the first line ``---`` and the next such line; null without one."""
    return F.nullif(F.regexp_extract(T.col(content), FRONT, 1), F.lit(""))


def is_generated_map(content: str | F.Column) -> F.Column:
    """Whether a note's frontmatter calls it a map note: only such may be overwritten."""
    kind = F.regexp_extract(F.coalesce(frontmatter(content), F.lit("")), r"(?m)^type:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.coalesce(F.regexp_replace(kind, r"^([\"'])(.*)\1$", "$2") == "moc", F.lit(False))


def with_metadata(notes: DataFrame) -> DataFrame:
    """Notes with ``tags``, ``links`` and ``n_links``, read from their content."""
    front = F.coalesce(frontmatter("content"), F.lit(""))
    body = F.regexp_replace("content", FRONT, "")
    value = F.regexp_extract(front, r"(?m)^tags?:[ \t]*\[?([^\]\r\n]*)\]?[ \t]*$", 1)
    value = F.translate(value, "'\"", "")
    rows = notes.withColumns({"tags": F.array_distinct(T.all_tags(T.inline_tags(body), T.frontmatter_tags(value))), "links": T.links("content")})
    return rows.withColumn("n_links", F.size("links").cast("long"))


def resolved_links(notes: DataFrame) -> DataFrame:
    """(src, dst, cnt): wiki links whose target is a note's path or, failing that, its only basename."""
    edges = notes.select(F.col("path").alias("src"), F.explode("links").alias("target")).groupBy("src", "target").agg(F.count("*").alias("cnt"))
    names = notes.select(F.col("path").alias("dst"), F.regexp_replace("path", r"(?i)\.md$", "").alias("full"))
    short = names.groupBy(T.basename("full").alias("name")).agg(F.min("dst").alias("short_dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    by_path = edges.join(names, F.col("target") == F.col("full"), "left").join(short, F.col("target") == F.col("name"), "left")
    dst = F.coalesce("dst", "short_dst")
    return by_path.where(dst.isNotNull()).groupBy("src", dst.alias("dst")).agg(F.sum("cnt").cast("long").alias("cnt"))


def normalized_events(events: DataFrame) -> DataFrame:
    """File events (op, path, new_path, ts, seq) as upserts, deletes and reconciles of Markdown notes (op, path, ts, seq, part)."""
    old, new = T.is_markdown("path"), T.is_markdown("new_path")
    step = lambda op, path, part: F.struct(F.lit(op).alias("op"), F.col(path).alias("path"), F.lit(part).alias("part"))
    rename = F.filter(F.array(F.when(old, step("delete", "path", 0)), F.when(new, step("upsert", "new_path", 1))), lambda s: s.isNotNull())
    none = F.array().cast("array<struct<op:string,path:string,part:int>>")
    steps = (
        F.when(F.col("op") == "reconcile", F.array(F.struct(F.lit("reconcile").alias("op"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("part"))))
        .when(F.col("op") == "rename", rename)
        .when(F.col("op").isin("create", "modify") & old, F.array(step("upsert", "path", 0)))
        .when((F.col("op") == "delete") & old, F.array(step("delete", "path", 0)))
        .otherwise(none)
    )
    others = [c for c in events.columns if c not in ("op", "path", "new_path")]
    return events.withColumn("s", F.explode(steps)).select("s.op", "s.path", "s.part", *others)


# what the generated tables stand for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_path() -> F.Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".md")))


def notes_of(documents: DataFrame) -> DataFrame:
    """(doc_id, path, content, mtime, tags): documents as notes; the first sentence is the heading, and tags name language and source."""
    content = F.concat(F.lit("---\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n---\n# Note "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n"))
    return documents.select("doc_id", note_path().alias("path"), content.alias("content"), F.col("n_chars").alias("mtime"), F.array(F.concat(F.lit("#"), "lang"), F.concat(F.lit("#"), "source")).alias("tags"))


def chunk_vectors(embeddings: DataFrame, size: int = 5) -> DataFrame:
    """(id, path, ordinal, vector): ``size`` consecutive vectors make a document."""
    from ..functions.vectors import unit_f32

    if size < 1:
        raise ValidationError("size must be positive")
    document = F.floor(F.col("vec_id") / size)
    return embeddings.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("doc-"), F.lpad(document.cast("string"), 6, "0")).alias("path"), (F.col("vec_id") % size).cast("int").alias("ordinal"), unit_f32("embedding").alias("vector"))

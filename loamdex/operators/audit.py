"""Structural and note-by-note audits of a collection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .ordered import parted
from .shared import checkpointed

DAY_MS = 86_400_000


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


# structure


def backlinks(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes with ``n_backlinks``; self-links count, links of count 0 don't."""
    counts = links.where("cnt > 0").groupBy(F.col("dst").alias("_dst")).agg(F.sum("cnt").cast("long").alias("n"))
    return notes.join(counts, notes["path"] == counts["_dst"], "left").withColumn("n_backlinks", F.coalesce("n", F.lit(0)).cast("long")).drop("n", "_dst")


def is_orphan() -> Column:
    return (F.col("n_links") + F.col("n_backlinks")) == 0


def totals(notes: DataFrame) -> DataFrame:
    """One row: totals, connectivity in percent, and the flags of a disorderly or ill-linked collection."""
    one = notes.agg(F.count("*").alias("total"), F.count_if(F.size("tags") > 0).alias("with_tags"), F.count_if(is_orphan()).alias("orphaned"))
    connected = F.when(F.col("total") == 0, 0).otherwise(js_round((F.col("total") - F.col("orphaned")) / F.col("total") * 100)).cast("long")
    return one.withColumns({"connectivity": connected, "chaos": F.col("with_tags") < 0.2 * F.col("total"), "ill_linked": F.col("orphaned") > 0.3 * F.col("total")})


def folder_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(T.parent_folder("path").alias("folder")).agg(F.count("*").alias("n"), F.min("path").alias("first"))


def tag_counts(notes: DataFrame) -> DataFrame:
    """Notes per tag; a note's tags are distinct, case counts."""
    tags = notes.select("path", F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def most(counts: DataFrame, key: str, limit: int) -> DataFrame:
    """Largest counts, ties by first appearance."""
    return counts.orderBy(F.desc("n"), "first", key).limit(limit).select(key, "n")


def collected(notes: DataFrame, config_dir: str = ".config", backups: bool = True, dot_names: bool = True, templates_any_case: bool = True) -> DataFrame:
    """Notes that an audit takes. The collectors differ in what they leave out: backup folders, names with a dot first, templates in any case."""
    path = F.lower("path")
    keep = T.is_markdown("path") & ~path.startswith(config_dir.lower() + "/") & ~(path if templates_any_case else F.col("path")).startswith("templates/")
    if backups:
        keep &= ~path.startswith(".ai-backup")
    if dot_names:
        keep &= ~T.basename("path").startswith(".")
    return notes.where(keep)


def batch_filter(notes: DataFrame, folder: str = "", tags: str = "", from_date: str = "", to_date: str = "") -> DataFrame:
    """Notes in a folder, with any of the tags (comma-separated), changed from a day to the end of another (UTC)."""
    out = notes.where(~F.col("path").startswith(".") & ~F.col("path").startswith("templates/"))
    if folder:
        out = out.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    wanted = [t.strip().lstrip("#").lower() for t in tags.split(",") if t.strip()]
    if wanted:
        own = F.transform("tags", lambda t: F.lower(F.regexp_replace(t, "^#", "")))
        out = out.where(F.arrays_overlap(own, F.array(*map(F.lit, wanted))))
    day = lambda d: F.unix_millis(F.to_utc_timestamp(F.to_timestamp(F.lit(d)), F.current_timezone()))
    if from_date:
        out = out.where(F.col("mtime") >= day(from_date))
    return out.where(F.col("mtime") <= day(to_date) + DAY_MS) if to_date else out


# freshness


def with_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files with ``state``: fresh, stale (another mtime) or unseen."""
    known = records.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), "quality", "mode")
    both = files.join(known, files["path"] == known["_path"], "left")
    return both.withColumn("state", F.when(F.col("_path").isNull(), "unseen").when(F.col("_mtime").eqNullSafe(F.col("mtime")), "fresh").otherwise("stale")).drop("_path", "_mtime")


def index_stats(files: DataFrame, records: DataFrame) -> DataFrame:
    """(measure, key, n): counts by state, and of fresh notes by quality and mode."""
    rows = with_records(files, records)
    fresh = rows.where("state = 'fresh'")
    by = lambda df, measure, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "key", "n")
    return by(rows, "state", F.col("state")).union(by(fresh, "quality", F.coalesce("quality", F.lit("draft")))).union(by(fresh, "mode", F.coalesce("mode", F.lit("unknown"))))


def stale(files: DataFrame, records: DataFrame) -> DataFrame:
    return with_records(files, records).where("state <> 'fresh'")


def pruned(records: DataFrame, files: DataFrame) -> DataFrame:
    return records.join(files.select("path"), "path", "left_semi")


def estimate(notes: int, batch: int = 5, concurrency: int = 3, delay: int = 1000, reduce: int = 8) -> dict:
    """Requests and minutes of a batch audit, and minutes note by note."""
    batches = -(-notes // batch)
    return {"batches": batches, "requests": batches + -(-batches // reduce) + 1, "minutes": -(-batches * (delay + 3000) // (concurrency * 60000)), "single_minutes": -(-notes * (delay + 5000) // 60000)}


# note audits


def note_block(path: str | Column, tags: str | Column, content: str | Column, limit: int = 4000) -> Column:
    """What a batch holds of a note: its path, name, tags and its content, truncated."""
    path = T.col(path)
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.lit("\n=== FILE ===\nPATH: "), path, F.lit("\nBASENAME: "), name, F.lit("\nEXISTING_TAGS: "), T.col(tags), F.lit("\nCONTENT:\n"), T.truncated(content, limit), F.lit("\n=== END FILE ===\n"))


def fold_batches(sizes: list[int], state: tuple[int, int], batch_files: int, batch_chars: int) -> tuple[list[bool], tuple[int, int]]:
    """Which notes open a batch, and the (notes, characters) of the batch still open."""
    n, chars = state
    opens = []
    for size in sizes:
        full = n > 0 and (n >= batch_files or chars + size > batch_chars)
        n, chars = (1, size) if full else (n + 1, chars + size)
        opens.append(full)
    return opens, (n, chars)


class Exits:
    """For each number of leading notes that belong to an earlier batch: how many notes after a range its last batch takes, and the batches begun in it.

    The sizes come bit by bit; folds that have come to the same open batch go on as one.
    """

    def __init__(self, batch_files: int, batch_chars: int):
        self.files, self.chars, self.seen = batch_files, batch_chars, 0
        #: Folds by their open batch, (notes, characters): the entries that have come to it, with the batches each has begun.
        self.folds: dict[tuple[int, int], dict[int, int]] = {}

    def take(self, sizes: list[int]) -> None:
        for size in sizes:
            grown: dict[tuple[int, int], dict[int, int]] = {}
            for (n, chars), begun in self.folds.items():
                full = n >= self.files or chars + size > self.chars
                grown.setdefault((1, size) if full else (n + 1, chars + size), {}).update({e: k + full for e, k in begun.items()} if full else begun)
            if self.seen < self.files:
                grown.setdefault((1, size), {})[self.seen] = 1
            self.folds, self.seen = grown, self.seen + 1

    def result(self, after: list[int]) -> list[tuple[int, int]]:
        """after: sizes of the next notes, as many as a batch may still take."""
        out = {e: (e - self.seen, 0) for e in range(self.seen, self.files)}
        for state, begun in self.folds.items():
            taken = fold_batches(after, state, self.files, self.chars)[0]
            out |= {e: (taken.index(True) if True in taken else len(taken), k) for e, k in begun.items()}
        return [out[e] for e in range(self.files)]


def packed(notes: DataFrame, batch_files: int = 5, batch_chars: int = 20_000, parts: int = 0) -> DataFrame:
    """(part, batch, path, position): notes (path, size), in path order, in batches of bounded number and size; a null size is 0.

    Packing restarts where a batch is full, so it is a fold over the order. The
    path order is cut in ``parts`` ranges (0: as many as shuffle partitions), which
    change only the column part. A range's first batch starts at one of its first
    ``batch_files`` notes (or later, if it is shorter): each range gives, for each
    such entry, where the next range is entered and how many batches begin in it.
    The driver composes these small maps; then every range folds on from its own entry.
    """
    files = max(batch_files, 1)
    parts = parts or int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sizes are computed once; all that follows reads paths and sizes alone
    rows = checkpointed(notes.select("path", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")))
    placed = parted(rows, F.col("path"), "part", parts).repartition(parts, "part").sortWithinPartitions("part", "path", "size")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Each batch's stretches of one part."""
        for batch in batches:
            part = batch.column("part").to_numpy()
            ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for at, end in zip([0, *ends], ends):
                yield int(part[at]), batch.slice(at, end - at)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stretches in groupby(ranges(batches), lambda x: x[0]):
            first, n = [], 0
            for _, batch in stretches:
                first += batch.column("size").slice(0, files - len(first)).to_pylist()
                n += batch.num_rows
            yield pa.RecordBatch.from_pylist([{"part": part, "n": n, "first": first}], pa.schema({"part": pa.int32(), "n": pa.int64(), "first": pa.list_(pa.int64())}))

    known = sorted(placed.mapInArrow(heads, "part int, n long, first array<long>").collect())
    after: dict[int, list] = {}
    for k, r in enumerate(known):
        following: list = []
        for later in known[k + 1 :]:
            following += later.first
            if len(following) >= files:
                break
        after[r.part] = following[:files]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stretches in groupby(ranges(batches), lambda x: x[0]):
            folds = Exits(files, batch_chars)
            for _, batch in stretches:
                folds.take(batch.column("size").to_pylist())
            found = folds.result(after[part])
            yield pa.RecordBatch.from_pylist([{"part": part, "entry": e, "leaves": leaves, "begun": begun} for e, (leaves, begun) in enumerate(found)], pa.schema({"part": pa.int32(), "entry": pa.int32(), "leaves": pa.int32(), "begun": pa.int64()}))

    steps = {(r.part, r.entry): (r.leaves, r.begun) for r in placed.mapInArrow(mapped, "part int, entry int, leaves int, begun long").collect()} if len(known) > 1 else {}
    entries, entry, begun = {}, 0, 0
    for r in known:
        entries[r.part] = (entry, begun)
        if steps:
            entry, more = steps[r.part, entry]
            begun += more

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stretches in groupby(ranges(batches), lambda x: x[0]):
            (skip, batch_no), state = entries[part], (0, 0)
            batch_no -= 1
            for _, batch in stretches:
                early = min(skip, batch.num_rows)
                numbers, skip = [batch_no] * early, skip - early
                opens, grown = fold_batches(batch.column("size").to_pylist()[early:], state, files, batch_chars)
                if opens and state[0] == 0:
                    opens[0] = True
                for opened in opens:
                    batch_no += opened
                    numbers.append(batch_no)
                state = grown
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(numbers, pa.int32()), batch.column("path")], ["part", "batch", "path"])

    flat = placed.mapInArrow(numbered, "part int, batch int, path string")
    return flat.withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("path")) - 1)


def reduce_groups(batches: DataFrame, size: int = 24) -> DataFrame:
    """Consecutive batch summaries in groups of ``size``."""
    return batches.withColumn("reduce_group", F.floor(F.col("batch") / size).cast("long"))


def cluster_key() -> Column:
    """Name, trimmed and in lower case; unnamed clusters have their seq."""
    name = T.trim_blank(F.coalesce("name", F.lit("")))
    return F.when(name == "", F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("="), F.lower(name)))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(key, path, seq, place): a row for each path of each merged cluster, with where it first appears; (seq, place) is the order."""
    listed = clusters.select(cluster_key().alias("key"), "seq", F.posexplode("paths").alias("place", "path"))
    return listed.groupBy("key", "path").agg(F.min(F.struct("seq", "place")).alias("at")).select("key", "path", "at.seq", "at.place")


def cluster_heads(clusters: DataFrame) -> DataFrame:
    """(key, seq, name, description, moc, file_count): each merged cluster without its paths.

    The description that is longest when trimmed wins, as it is (the earlier of equal
    ones), and the first suggestion that isn't blank.
    """
    about = T.trim_blank(F.coalesce("description", F.lit("")))
    moc = F.when(T.trim_blank(F.coalesce("moc", F.lit(""))) != "", F.col("moc"))
    heads = clusters.groupBy(cluster_key().alias("key")).agg(
        F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"), F.max_by(F.coalesce("description", F.lit("")), F.struct(F.length(about), -F.col("seq"))).alias("description"),
        F.min_by(moc, F.when(moc.isNotNull(), F.col("seq"))).alias("moc"),
    )
    counts = cluster_members(clusters).groupBy("key").agg(F.count("*").alias("file_count"))
    return heads.join(counts, "key", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("long")))


def dedupe_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters of one name (trimmed, any case) become one; unnamed ones stay apart.

    clusters: (seq, name, description, paths, moc). Paths are joined in order of first
    appearance; output order is of first appearance. A row holds all distinct paths of
    its cluster: where a cluster may be large, use ``cluster_heads`` and ``cluster_members``.
    """
    spots = F.transform(F.array_sort(F.collect_list(F.struct("seq", "place", "path"))), lambda x: x["path"])
    paths = cluster_members(clusters).groupBy("key").agg(spots.alias("paths"))
    merged = cluster_heads(clusters).join(paths, "key", "left")
    return merged.select("seq", "name", "description", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), "moc", "file_count")


RECORD = "mainIdea string, keyPoints array<string>, entities array<string>, quality string, suggestedTags array<string>, topics array<string>, suggestedLinks array<string>"
#: What a note may be called.
QUALITIES = ("draft", "developed", "polished")


def coerced_record(answer: str | Column, word_count: str | Column | None = None, links: str | Column | None = None) -> Column:
    """A model's answer as a record: lists capped, wrong shapes empty, unknown qualities ``draft``; what can't be read says so.

    word_count and links (in and out) are the note's own; without links it is an orphan.
    """
    none = F.array().cast("array<string>")
    words, linked = (F.lit(0) if c is None else F.coalesce(T.col(c), F.lit(0)) for c in (word_count, links))

    def coerced(record: Column) -> Column:
        capped = lambda name, n: F.slice(F.coalesce(record[name], none), 1, n).alias(name)
        idea = F.when(record.isNull(), "The model's answer can't be read").otherwise(F.substring(F.coalesce(record["mainIdea"], F.lit("")), 1, 300))
        quality = F.when(record["quality"].isin(*QUALITIES), record["quality"]).otherwise("draft")
        return F.struct(
            idea.alias("mainIdea"), capped("keyPoints", 7), capped("entities", 15), quality.alias("quality"), capped("suggestedTags", 8), words.cast("long").alias("wordCount"),
            F.coalesce(record["topics"], none).alias("topics"), capped("suggestedLinks", 5), (linked == 0).alias("orphan"), F.lit("single").alias("mode"),
        )

    return T.let(F.from_json(T.extracted_json(answer), RECORD), coerced)


CLUSTERS = "clusters array<struct<name:string,description:string,suggestedMOC:string,filePaths:array<string>>>"


def coerced_clusters(answers: DataFrame) -> DataFrame:
    """(seq, name, description, moc, paths, file_count): clusters in models' answers; answers: (seq, answer).

    Missing fields are empty, names are trimmed; an answer that can't be read has none.
    A cluster's seq is 2**20 times its answer's plus its place there, so order stays.
    """
    none = F.array().cast("array<string>")
    rows = answers.select("seq", F.posexplode(F.from_json(T.extracted_json("answer"), CLUSTERS)["clusters"]).alias("place", "c")).where("c IS NOT NULL")
    text = lambda name: F.coalesce(F.col("c")[name], F.lit(""))
    return rows.select(
        (F.col("seq").cast("long") * 2**20 + F.col("place")).alias("seq"), T.trim_blank(text("name")).alias("name"), text("description").alias("description"),
        text("suggestedMOC").alias("moc"), F.coalesce("c.filePaths", none).alias("paths"), F.coalesce(F.size("c.filePaths"), F.lit(0)).cast("long").alias("file_count"),
    )


def joined_clusters(parts: list[DataFrame]) -> DataFrame:
    """Partial lists of clusters one after the other: a list's place times 2**50 is added to its seqs."""
    return reduce(DataFrame.unionByName, (p.withColumn("seq", F.col("seq") + F.lit(i << 50)) for i, p in enumerate(parts)))


def joined_answers(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Answers with ``known``, ``mtime``, ``word_count``, ``basename`` and ``orphan`` of the file with their path.

    files: (path, mtime, n_links, n_backlinks, word_count). An answer about no known
    file stays as it is, for the report; only ``known`` ones belong in the index.
    """
    own = files.select(F.col("path").alias("_path"), "mtime", "word_count", is_orphan().alias("_orphan"))
    both = answers.join(own, answers["path"] == own["_path"], "left")
    known = F.col("_path").isNotNull()
    name = F.regexp_replace(T.basename("path"), r"\.[^.]*$", "")
    return both.withColumns({"known": known, "basename": F.when(known, name), "orphan": F.when(known, F.col("_orphan"))}).drop("_path", "_orphan")


def quality_counts(summaries: DataFrame) -> DataFrame:
    """One row: summaries by quality, and orphans."""
    return summaries.agg(*(F.count_if(F.col("quality") == q).alias(q) for q in QUALITIES), F.count_if("orphan").alias("orphans"))


def audit_counters(files: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: files (total), answered (processed), left out as fresh (skipped) and without an answer (failed).

    files: (path, state); answers: (path, error), at most one for each stale or unseen file.
    """
    done = answers.where("error IS NULL").select(F.col("path").alias("_path")).distinct()
    both = files.join(done, files["path"] == done["_path"], "left")
    fresh, answered = F.col("state") == "fresh", F.col("_path").isNotNull()
    return both.agg(F.count("*").alias("total"), F.count_if(~fresh & answered).alias("processed"), F.count_if(fresh).alias("skipped"), F.count_if(~fresh & ~answered).alias("failed"))

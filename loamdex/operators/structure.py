"""Lines, headings and sections of Markdown notes, as DataFrames.

Notes are exploded into lines once they have been moved to a partition of their own;
everything after that is windows over the lines of a note, without another
exchange. Offsets count UTF-16 units.

``cache``, if there is such a column, is what an editor knows of a note:
``frontmatter_position`` (start, end) and ``headings`` (heading, level, start, end), each
end a (line, col, offset). It is believed only where it agrees with the text:
the front matter's place by itself, headings all or none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What names a note: rows that share path and content are told apart by ``nth``.
NOTE = ["path", "key", "nth"]
#: The order of a note's rows: lines, and cached headings before theirs.
PLACE = ["i", "rank", "at"]
_SPOT = "struct<line: int, col: int, offset: int>"
_HEADING = f"struct<heading: string, level: int, start: {_SPOT}, end: {_SPOT}>"
_CACHE = f"struct<frontmatter_position: struct<start: {_SPOT}, end: {_SPOT}>, headings: array<{_HEADING}>>"
_LINE = "struct<i: int, rank: int, raw: string, delta: int, h: struct<at: int, h: " + _HEADING + ">>"
FENCE = r"^ {0,3}(`{3,}(?=[^`]*\z)|~{3,})"
MARKER = r"^( *)(?:[-+*]|([0-9]+[.)]))[ \t]+"


def text_of(raw: str | Column) -> Column:
    """A line without the carriage return of its line break."""
    raw = T.col(raw)
    return F.when(raw.endswith("\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)


def marks(line: Column) -> Column:
    """The characters that open a fence, or an empty string."""
    return F.regexp_extract(line, FENCE, 1)


def closing_marks(line: Column) -> Column:
    """The characters of a line that can close a fence, or an empty string."""
    return F.regexp_extract(line, r"^ {0,3}(`+|~+)[ \t]*\z", 1)


def heading_level(line: str | Column) -> Column:
    """1 to 6 for an ATX heading, else null."""
    return F.nullif(F.length(F.regexp_extract(T.col(line), r"(?s)^ {0,3}(#{1,6})(?:[ \t].*)?\z", 1)), F.lit(0))


def heading_text(line: str | Column) -> Column:
    """Text of an ATX heading without its closing marks."""
    rest = T.trim_blank(F.regexp_extract(T.col(line), r"(?s)^ {0,3}#{1,6}[ \t](.*)\z", 1))
    # a heading of marks alone is not its own closing sequence
    return T.normalize_heading(F.regexp_replace(rest, r"[ \t]+#+[ \t]*\z", ""))


def root_heading(path: str | Column) -> Column:
    """File name without its extension, or Untitled."""
    name = T.normalize_heading(F.regexp_replace(T.basename(path), r"(?i)\.md\z", ""))
    return F.when(name == "", "Untitled").otherwise(name)


def _is_rule(line: Column) -> Column:
    return line.isin("---", "---\r")


def body_line(raw: str, cached: Column) -> Column:
    """The line that follows the front matter; 0 without any."""
    start, end = cached["start"], cached["end"]
    before = F.aggregate(F.slice(raw, 1, F.greatest(end["line"], F.lit(0))), F.lit(0), lambda n, x: n + T.utf16_length(x) + 1)
    right = (start["line"] == 0) & (start["col"] == 0) & (start["offset"] == 0) & (end["line"] > 0) & _is_rule(F.get(raw, end["line"])) & (end["col"] == 3) & (end["offset"] == before + 3)
    rest = F.slice(raw, 2, F.greatest(F.size(raw), F.lit(1)))
    closing = F.least(*(F.nullif(F.array_position(rest, F.lit(rule)), F.lit(0)) for rule in ("---", "---\r"))).cast("int")
    found = F.when(F.coalesce(right, F.lit(False)), end["line"] + 1).otherwise(F.coalesce(closing + 1, F.lit(0)))
    first = F.get(raw, F.lit(0))
    return F.when(_is_rule(first) | _is_rule(F.regexp_replace(first, "^\ufeff", "")), found).otherwise(0)


def _fence_events(notes: pd.Series) -> pd.Series:
    """Where code blocks open (1) and close (-1), from each note's lines (i, opens, closes) that look like fences."""
    out = []
    for lines in notes:
        opened, events = "", []
        for line in lines:
            if opened:
                if len(line["closes"]) >= len(opened) and line["closes"][0] == opened[0]:
                    opened = ""
                    events.append({"i": line["i"], "delta": -1})
            elif line["opens"]:
                opened = line["opens"]
                events.append({"i": line["i"], "delta": 1})
        out.append(events)
    return pd.Series(out, dtype=object)


def fences(raw: str, body: str) -> Column:
    """Where code blocks of the body open (1) and close (-1). What closes one depends on what opened it, so a note's fences are gone through in order."""
    spots = F.transform(raw, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    some = F.filter(spots, lambda c: (c["i"] >= F.col(body)) & (F.contains(c["x"], F.lit("```")) | F.contains(c["x"], F.lit("~~~"))))
    marked = F.transform(some, lambda c: F.struct(c["i"].alias("i"), marks(text_of(c["x"])).alias("opens"), closing_marks(text_of(c["x"])).alias("closes")))
    return F.pandas_udf(_fence_events, "array<struct<i:int,delta:int>>")(F.filter(marked, lambda c: (c["opens"] != "") | (c["closes"] != "")))


def numbered(notes: DataFrame) -> DataFrame:
    """(path, key, nth, cache, raw, body, fences): filled notes with their lines as an array."""
    refused = lambda c: F.coalesce(c, F.raise_error(F.lit("a note needs a path and content")))
    cache = F.from_json(F.to_json("cache"), _CACHE) if "cache" in notes.columns else F.lit(None).cast(_CACHE)
    rows = notes.select(refused(F.col("path")).alias("path"), refused(F.col("content")).alias("content"), cache.alias("cache")).where("content <> ''")
    # the end of the last line begins no line
    raw = F.split(F.regexp_replace("content", r"\n\z", ""), "\n", -1)
    rows = rows.select("path", F.xxhash64("content").alias("key"), "cache", raw.alias("raw"))
    rows = rows.withColumn("body", body_line("raw", F.col("cache.frontmatter_position")))
    # before notes are moved: Spark doesn't know what a Python function's rows are dealt by, and would move all lines again
    rows = rows.withColumn("fences", fences("raw", "body"))
    same = Window.partitionBy("path", "key").orderBy("cache")
    return rows.withColumn("nth", F.row_number().over(same)).select(*NOTE, "cache", "raw", "body", "fences")


def lines(notes: DataFrame) -> DataFrame:
    """(path, key, nth, body, cached, i, rank, raw, text, start, end, fenced, at, h): the notes' lines, and cached headings as rows before theirs.

    cached: number of headings in the cache, or null.
    """
    rows = numbered(notes)
    known = F.col("cache.headings")
    cached = F.transform(known, lambda h, k: F.struct(F.coalesce(h["start"]["line"], F.lit(-1)).alias("i"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("raw"), F.lit(0).alias("delta"), F.struct(k.alias("at"), h.alias("h")).alias("h")).cast(_LINE))
    own = F.transform("raw", lambda x, i: F.struct(i.alias("i"), F.lit(2).alias("rank"), x.alias("raw"), F.lit(0).alias("delta"), F.lit(None).alias("h")).cast(_LINE))
    marked = F.transform("fences", lambda e: F.struct(e["i"].alias("i"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("raw"), e["delta"].alias("delta"), F.lit(None).alias("h")).cast(_LINE))
    every = F.concat(own, marked, F.coalesce(cached, F.array().cast(f"array<{_LINE}>"))) if "cache" in notes.columns else F.concat(own, marked)
    count = F.when(known.isNotNull(), F.size(known)) if "cache" in notes.columns else F.lit(None).cast("int")
    rows = rows.select(*NOTE, "body", count.alias("cached"), F.explode(every).alias("e")).select(*NOTE, "body", "cached", "e.*", F.coalesce("e.h.at", F.lit(0)).alias("at"))
    place = Window.partitionBy(*NOTE).orderBy(*PLACE)
    rows = rows.withColumn("size", T.utf16_length("raw"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    rows = rows.withColumn("fenced", F.sum("delta").over(place.rowsBetween(Window.unboundedPreceding, 0)) > 0).where("rank <> 1")
    text = text_of("raw")
    return rows.select(*NOTE, "body", "cached", "i", "rank", "raw", text.alias("text"), "start", (F.col("start") + T.utf16_length(text)).alias("end"), "fenced", "at", "h")


def believed(rows: DataFrame) -> DataFrame:
    """Lines with ``level``, ``title`` and ``after`` (where the body begins) of the cached headings; these rows stay if all of a note's are right."""
    place = Window.partitionBy(*NOTE).orderBy(*PLACE)
    line = F.when(F.col("rank") == 2, F.struct("i", "text", "start", "end", (F.col("start") + F.length(F.encode("raw", "UTF-16BE")) / 2 + 1).cast("int").alias("full")))
    rows = rows.withColumn("line", line)
    spec = "over (partition by path, key, nth order by i, rank, at)"
    rows = rows.withColumn("one", F.expr(f"lead(line, 1) ignore nulls {spec}")).withColumn("two", F.expr(f"lead(line, 2) ignore nulls {spec}"))
    h, one, two = F.col("h.h"), F.col("one"), F.col("two")
    title, start, end = T.normalize_heading(h["heading"]), h["start"], h["end"]
    ends = lambda x: (end["offset"] == x["end"]) & (end["col"] == x["end"] - x["start"])
    under = F.regexp_extract(two["text"], r"^ {0,3}(=+|-+)[ \t]*\z", 1)
    flush = one["text"].rlike(r"^ {0,3}(?![ \t])") & (title != "") & (T.normalize_heading(one["text"]) == title)
    setext = (end["line"] == one["i"] + 1) & ends(two) & (under != "") & (h["level"] == F.when(under.startswith("="), 1).otherwise(2)) & flush
    atx = (end["line"] == one["i"]) & ends(one) & (heading_level(one["text"]) == h["level"]) & (heading_text(one["text"]) == title)
    common = (one["i"] == F.col("i")) & (start["offset"] == one["start"]) & (start["col"] == 0) & (end["offset"] > start["offset"]) & h["level"].between(1, 6)
    is_one = F.col("rank") == 0
    rows = rows.withColumn("after", F.when(is_one, F.when(end["line"] == one["i"], one["full"]).otherwise(two["full"])))
    upto = F.max("after").over(place.rowsBetween(Window.unboundedPreceding, -1))
    count = F.count("h").over(place.rowsBetween(Window.unboundedPreceding, 0))
    right = common & (atx | setext) & (F.col("i") >= F.col("body")) & (F.coalesce(upto, F.lit(0)) <= one["start"]) & (F.col("at") == count - 1)
    rows = rows.withColumn("right", F.when(is_one, F.coalesce(right, F.lit(False))))
    trust = F.col("cached").isNotNull() & F.coalesce(F.min("right").over(Window.partitionBy(*NOTE)), F.lit(True))
    rows = rows.withColumn("trust", trust).where("rank = 2 OR trust")
    return rows.withColumn("level", F.when(is_one, h["level"])).withColumn("title", F.when(is_one, title)).drop("line", "one", "two", "right", "h")


def headings(notes: DataFrame) -> DataFrame:
    """Lines of the notes' bodies with ``level``, ``title`` and ``after`` where a heading is.

    A heading's row is its line, or a row before its lines if it comes from the cache.
    """
    rows = lines(notes)
    if "cache" in notes.columns:
        rows = believed(rows)
    else:
        rows = rows.select("*", F.lit(False).alias("trust"), *(F.lit(None).cast(t).alias(n) for n, t in (("after", "int"), ("level", "int"), ("title", "string")))).drop("h")
    rows = rows.where("i >= body")
    scanned = ~F.col("trust") & ~F.col("fenced")
    rows = rows.withColumn("own", F.when(scanned, heading_level("text")))
    is_own = F.col("own").isNotNull()
    after = F.coalesce("after", F.when(is_own, F.col("start") + T.utf16_length("raw") + 1))
    return rows.select("*", after.alias("past"), F.coalesce("title", F.when(is_own, heading_text("text"))).alias("name"), F.coalesce("level", "own").alias("rung")).drop("own", "after", "title", "level").withColumnsRenamed({"past": "after", "name": "title", "rung": "level"})


def sections(notes: DataFrame) -> DataFrame:
    """Body lines with ``heading_path`` and ``after`` where a section ``begins``: at headings, and at a note's first line.

    Of the headings so far, the last one of each level stays in the path unless one of
    a higher rank came later. Lines that begin before ``after`` belong to the heading.
    """
    rows = headings(notes)
    place = Window.partitionBy(*NOTE).orderBy(*PLACE)
    sofar = place.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("i", "title")), ignorenulls=True).over(sofar) for k in range(1, 7)]
    rows = rows.select("*", *(c.alias(f"last{k}") for k, c in enumerate(last, 1)), F.lag("i").over(place).isNull().alias("first"))
    above = []
    for k in range(1, 7):
        higher = F.greatest(F.lit(-1), *(F.col(f"last{m}.i") for m in range(1, k))) if k > 1 else F.lit(-1)
        above.append(F.when((F.col("level") >= k) & (F.col(f"last{k}.i") > higher), F.col(f"last{k}.title")))
    path = F.filter(F.array(*above), lambda t: t.isNotNull() & (t != ""))
    root = F.array(root_heading("path"))
    is_heading = F.col("level").isNotNull()
    found = F.when(is_heading, F.when(F.size(path) > 0, path).otherwise(root)).when(F.col("first"), root)
    begins = is_heading | F.col("first")
    return rows.select(*NOTE, *PLACE, "raw", "text", "start", "end", "level", begins.alias("begins"), found.alias("heading_path"), F.when(is_heading, F.col("after")).when(F.col("first"), F.col("start")).alias("after"))


def _delimits(line: Column) -> Column:
    """Whether a line is the rule below a table's head."""
    cells = F.split(F.regexp_replace(F.regexp_replace(T.trim_blank(line), r"^\|", ""), r"\|\z", ""), r"\|", -1)
    return F.contains(line, F.lit("|")) & F.forall(cells, lambda c: T.trim_blank(c).rlike(r"^:?-{3,}:?\z"))


def kinds(rows: DataFrame) -> DataFrame:
    """Sections' lines with what a block that began there would be (``kind``, empty for blank lines), and what decides how far it goes."""
    place = Window.partitionBy(*NOTE).orderBy(*PLACE)
    text = F.col("text")
    below = F.lead(F.when(~F.col("begins"), text)).over(place)
    table = F.contains(text, F.lit("|")) & F.coalesce(_delimits(below), F.lit(False))
    html = rf"^ {{0,3}}<(?:!--|/?[A-Za-z][A-Za-z0-9_-]*[>/{T.BLANK}])"
    kind = (
        F.when(~text.rlike(f"[^{T.BLANK}]"), "").when(marks(text) != "", "code").when(table, "table").when(text.rlike(r"^ {0,3}(?:[-+*]|[0-9]+[.)])[ \t]+"), "list")
        .when(text.rlike(r"^ {0,3}>"), "quote").when(text.rlike(html), "html").otherwise("paragraph")
    )
    marker = F.when(text.rlike(MARKER), F.struct(F.length(F.regexp_extract(text, MARKER, 1)).alias("indent"), (F.regexp_extract(text, MARKER, 2) != "").alias("ordered")))
    return rows.select("*", kind.alias("kind"), marks(text).alias("opens"), closing_marks(text).alias("closes"), marker.alias("marker"))

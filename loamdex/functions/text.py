"""Text functions as Column expressions.

Offsets and lengths named utf16 count UTF-16 code units; ``length`` and
``substring`` of Spark count code points, which is what previews want.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as blank (Unicode spaces, NBSP and U+FEFF, but not U+0085), for a regex class.
BLANK = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of them. Most characters are below U+1680 and are done with two tests instead of one for each range.
BLANK_RUN = rf"[\t-\r \u00a0[\u1680-\ufeff&&[{BLANK}]]]+"
#: The same characters as a text.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LINK = r"(?<!!)\[\[([^\]|#]+)"
TAG = r"(?<![\p{L}\p{N}])#[\p{L}][\p{L}\p{N}_/-]*"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_blank(c: str | Column) -> Column:
    # no pattern: it would try every blank within the text as the last ones
    return F.trim(col(c), F.lit(BLANKS))


def rtrim_blank(c: str | Column) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def collapse_blank(c: str | Column) -> Column:
    return trim_blank(F.regexp_replace(col(c), BLANK_RUN, " "))


def utf16_length(c: str | Column) -> Column:
    return (F.length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def utf16_order(c: str | Column) -> Column:
    """Sorts as UTF-16 code units do; plain strings sort by code point."""
    return F.encode(col(c), "UTF-16BE")


def stable_hash(c: str | Column) -> Column:
    """16 hexadecimal digits from two 32-bit lanes over the UTF-16 units.

    Longs are masked after every product: 32 by 32 bits stays below 2**63.
    """
    digits = F.hex(F.encode(col(c), "UTF-16BE"))
    units = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 4).cast("int")), lambda i: F.substring(digits, (i * 4 + 1).cast("int"), F.lit(4))), lambda u: u != "")
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc: Column, unit: Column) -> Column:
        u = F.conv(unit, 16, 10).cast("long")
        p = (acc["p"].bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(mask)
        q = (acc["q"].bitwiseXOR(u) * F.lit(0x5BD1E995).cast("long")).bitwiseAND(mask)
        return F.struct(p.alias("p"), q.bitwiseXOR(F.shiftrightunsigned(q, 13)).alias("q"))

    start = F.struct(F.lit(0x811C9DC5).cast("long").alias("p"), F.lit(0x9E3779B9).cast("long").alias("q"))
    lanes = F.aggregate(units, start, step)
    return F.lower(F.concat(F.lpad(F.hex(lanes["p"]), 8, "0"), F.lpad(F.hex(lanes["q"]), 8, "0")))


def preview(c: str | Column, limit: int = 240) -> Column:
    """Collapsed text of at most ``limit`` code points; null if nothing is left."""
    return F.nullif(F.substring(collapse_blank(c), 1, limit), F.lit(""))


def words(c: str | Column) -> Column:
    """What stands between blanks, in order."""
    return F.array_remove(F.split(col(c), BLANK_RUN), "")


def word_count(c: str | Column) -> Column:
    return F.size(words(c)).cast("long")


def meaningful_chars(c: str | Column) -> Column:
    """Letters and digits, in code points."""
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "")).cast("long")


def is_markdown(path: str | Column) -> Column:
    return F.lower(col(path)).endswith(".md")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent_folder(path: str | Column) -> Column:
    """Folder of a path; ``root`` for files at the top."""
    return F.coalesce(F.nullif(F.regexp_replace(col(path), r"/?[^/]*$", ""), F.lit("")), F.lit("root"))


def folder_ancestors(path: str | Column) -> Column:
    """All folders above a file, outermost first, without those that begin with a dot."""
    parts = F.split(col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.filter(folders, lambda f: ~f.startswith(".") & ~F.contains(f, F.lit("/."))))


def links(c: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(LINK), 1), lambda t: F.trim(t))


def inline_tags(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(TAG), 0)


def frontmatter_tags(c: str | Column) -> Column:
    """A tag line's value split at commas and blanks, each with its #."""
    parts = F.filter(F.split(col(c), f"[,{BLANK}]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))


def all_tags(inline: str | Column, frontmatter: str | Column) -> Column:
    """Distinct tags, inline ones first, in order of appearance."""
    return F.array_union(col(inline), col(frontmatter))


def normalize_heading(c: str | Column) -> Column:
    return F.regexp_replace(trim_blank(c), r"[ \t]+", " ")


def file_name(c: str | Column) -> Column:
    """A name that file systems take: forbidden characters become blanks, 80 characters at most."""
    clean = collapse_blank(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[\\/:*?"<>|#^\[\]]', " "))
    return trim_blank(F.substring(clean, 1, 80))


def topic_slug(c: str | Column) -> Column:
    """The first 30 characters' Latin and Cyrillic letters, digits and blanks, with hyphens; ``response`` if none."""
    kept = trim_blank(F.regexp_replace(F.substring(col(c), 1, 30), f"[^a-zA-Z0-9а-яА-ЯёЁ{BLANK}]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(kept, f"[{BLANK}]+", "-"), F.lit("")), F.lit("response"))


def wiki_link(path: str | Column) -> Column:
    target = F.regexp_replace(col(path), r"\.md$", "")
    base = basename(target)
    return F.when(target == base, F.concat(F.lit("[["), target, F.lit("]]"))).otherwise(F.concat(F.lit("[["), target, F.lit("|"), base, F.lit("]]")))


def append_section(content: str | Column, block: str | Column) -> Column:
    return F.concat(rtrim_blank(content), F.lit("\n\n"), col(block), F.lit("\n"))


def strip_fences(c: str | Column) -> Column:
    """Without code fences, wherever they are, their language names, and the line end behind them."""
    return trim_blank(F.regexp_replace(col(c), r"```[a-zA-Z]*\n?", ""))


def flashcards(c: str | Column) -> Column:
    """Lines ``front::back`` with both sides filled, without bullets, numbers and fences; one string."""
    lines = F.transform(F.split(strip_fences(c), r"\r?\n"), lambda x: trim_blank(F.regexp_replace(trim_blank(x), rf"^(?:[-*+•]|\d+[.)])[{BLANK}]+", "")))

    def whole(x: Column) -> Column:
        at = F.instr(x, "::")
        return (at > 0) & (trim_blank(F.substring(x, F.lit(1), at - 1)) != "") & (trim_blank(F.substring(x, at + 2, F.length(x))) != "")

    return F.array_join(F.filter(lines, whole), "\n")


def flashcards_section(content: str | Column, cards: str | Column) -> Column:
    checked = F.when(col(cards) == "", F.raise_error(F.lit("no flashcard was found"))).otherwise(col(cards))
    return append_section(content, F.concat(F.lit("## Flashcards\n#flashcards\n\n"), checked))


def repetition_loop(c: str | Column, window: int = 200, threshold: int = 3) -> Column:
    """Whether a text ends in ``threshold`` equal blocks of 20, 30, ..., window / 2 characters.

    Looks at the last ``threshold`` windows of a text of at least two; blocks that have
    under ten characters without the blanks at their ends don't count.
    """
    most = threshold * window
    tail = F.when(F.length(col(c)) > most, F.substring(col(c), -most, most)).otherwise(col(c))

    def loops(n: Column) -> Column:
        last = F.substring(tail, F.length(tail) - n + 1, n)
        again = [F.substring(tail, F.length(tail) - n * (k + 1) + 1, n) == last for k in range(1, threshold)]
        filled = F.length(trim_blank(last)) >= 10
        return reduce(lambda a, b: a & b, again, filled & (F.length(tail) >= n * threshold))

    return (F.length(col(c)) >= 2 * window) & F.exists(F.sequence(F.lit(20), F.lit(window // 2), F.lit(10)), loops)


def valid_path(path: str | Column) -> Column:
    """Whether a vault path is canonical: relative, trimmed, without empty, ``.`` or ``..`` parts."""
    p = col(path)
    bad = (p == "") | (p != trim_blank(p)) | p.contains("\x00") | p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.contains("\\") | p.rlike(r"(^|/)(\.{0,2})(/|$)")
    return ~F.coalesce(bad, F.lit(True))


def checked_path(path: str | Column) -> Column:
    return F.when(valid_path(path), col(path)).otherwise(F.raise_error(F.lit("a path isn't canonical")))


def extracted_json(raw: str | Column) -> Column:
    """The JSON part of a model's answer: fences go, it starts at the first bracket. Null unless that, or that up to the last bracket, is one JSON value as a whole."""
    from .answers import is_whole_json

    plain = trim_blank(F.regexp_replace(F.regexp_replace(col(raw), r"```(?i:json)\n?", ""), r"```\n?", ""))
    body = let(plain, lambda p: F.substring(p, F.nullif(F.regexp_instr(p, F.lit(r"[\{\[]")), F.lit(0)), F.length(p)))

    def parsed(b: Column) -> Column:
        shorter = let(F.regexp_extract(b, r"(?s)^(.*[\}\]])", 1), lambda cut: F.when(is_whole_json(cut), cut))
        return F.when(is_whole_json(b), b).otherwise(shorter)

    return let(body, parsed)


def dataview_query(raw: str | Column) -> Column:
    """A query block without fences and its leading language name; null unless its text starts as a query's does (``Tables`` does)."""
    plain = F.regexp_replace(strip_fences(raw), rf"(?i)^dataview[{BLANK}]*", "")
    return F.when(plain.rlike(r"(?i)^(TABLE|LIST|TASK|CALENDAR|FROM)"), plain)


def truncated(content: str | Column, limit: int) -> Column:
    """A note cut to about ``limit`` characters; what was cut ends with a mark.

    Frontmatter stays whole, unless it leaves no more than 100 characters: then the
    note is just cut off. What is left goes evenly to the sections (cut before
    headings of levels 1 to 4), which give their first paragraphs and the beginning
    of the next one.
    """
    c = col(content)
    front = F.regexp_extract(c, r"^(---[\s\S]*?---\n*)", 1)
    body, left = F.substring(c, F.length(front) + 1, F.length(c)), F.greatest(F.lit(0), limit - F.length(front))
    sections = F.split(body, r"(?m)(?=^#{1,4} )")
    share = F.floor(left / F.size(sections)).cast("int")

    def beginning(section: Column, budget: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

        def grown(at: Column, paragraph: Column) -> Column:
            over = F.length(at["text"]) + F.length(paragraph) + 2 > budget
            more = F.when(over, F.concat(at["text"], F.substring(paragraph, F.lit(1), budget - F.length(at["text"])), F.lit("…"))).otherwise(F.concat(at["text"], paragraph, F.lit("\n\n")))
            return F.when(at["full"], at).otherwise(F.struct(more.alias("text"), over.alias("full")))

        return F.aggregate(F.split(section, "\n\n"), start, grown, lambda at: at["text"])

    def joined(text: Column, section: Column) -> Column:
        budget = F.least(share, limit - F.length(text))
        return F.when(F.length(text) >= limit, text).when(F.length(section) <= budget, F.concat(text, section)).otherwise(F.concat(text, beginning(section, budget)))

    cut = F.aggregate(sections, front, joined)
    marked = F.when(F.length(cut) < F.length(c), F.concat(cut, F.lit("\n\n*[truncated]*"))).otherwise(cut)
    return F.when(F.length(c) <= limit, c).when(left <= 100, F.concat(F.substring(c, 1, limit), F.lit("\n…"))).otherwise(marked)


def breadcrumb(headings: str | Column) -> Column:
    """Headings that aren't blank, outermost first."""
    return F.array_join(F.filter(col(headings), lambda h: trim_blank(h) != ""), " › ")


def shown_name(path: str | Column) -> Column:
    """A path's last part without ``.md``; the path where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(basename(path), r"(?i)\.md$", ""), F.lit("")), col(path))


def score_text(score: str | Column) -> Column:
    """A score with three decimals, a dash if it isn't finite.

    The value in binary is rounded, ties away from zero: it is split in a float and
    the rest, whose thousandfolds are exact, so the half is decided by an exact sign.
    """
    x = F.abs(col(score))
    high = x.cast("float").cast("double")
    a, b = high * 1000, (x - high) * 1000
    low = F.floor(a + b).cast("double")
    n = (low + F.when((a - (low + 0.5)) + b >= 0, 1).otherwise(0)).cast("long")
    digits = F.concat(F.when(col(score) < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    finite = col(score).isNotNull() & ~F.isnan(col(score)) & (x != float("inf"))
    return F.when(~finite, "—").when(x < 1e12, digits).otherwise(F.format_string("%.3f", col(score)))


def has_section(content: str | Column, headings: list[str]) -> Column:
    """Whether a note holds a section's heading in any of its languages."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(col(content), F.lit(h)), F.lit(False)) for h in headings), F.lit(False))


def stamp(moment: str | Column, pattern: str = "dd-MM-yyyy HH-mm-ss") -> Column:
    """A time as file names take it; the clock is an argument, so reruns agree."""
    return F.date_format(col(moment), pattern)


def stamped_name(template: str, moment: str | Column, topic: str | Column) -> Column:
    """A name from a template with {{date}}, {{time}} and {{topic}}; a topic's own braces stay as they are."""
    values = {"{{date}}": stamp(moment, "yyyyMMdd"), "{{time}}": stamp(moment, "HHmm"), "{{topic}}": col(topic)}
    parts, rest = [], template
    while found := [(rest.index(k), k) for k in values if k in rest]:
        at, key = min(found)
        parts += [F.lit(rest[:at]), values[key]]
        rest = rest[at + len(key) :]
    return F.concat(*parts, F.lit(rest))

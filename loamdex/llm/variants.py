"""Spelling variant grouping: frequent words near each other, and the spelling each stands for.

Words are near if one inserted, deleted or replaced character makes one the other. No
pair of words is ever formed. Every word is filed under its wildcard keys (position,
prefix, suffix), where words that differ by a replacement there meet, under what is left
of it by each deletion, and under itself, where longer words meet it. A group keeps its
size and its two most frequent words; a member's share of it is the size without itself
and the first of the two that isn't itself. What a word collects is then combined: one
shuffle of about twice its length in rows a word, one of as many rows by word. A
group has at most as many words as there are letters (times positions for deletions).

Words are numbered in code-point order, so that shuffles carry numbers and ties are
decided by them. Prefixes and suffixes of words beyond ``LONG`` characters are
represented by their lengths and two polynomial hashes of 61 bits, so that such a word
costs rows by its length, not its square.

Nulls: a null text has no words; a null doc_id counts as the empty text in the hash.
Empty texts and tables give no rows. Very long texts are read whole, one at a time.
Ties: as stated, by code point. Repeated rows count again. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

#: A share of 1 / NOISE of the runs of a document loses a character.
NOISE = 97
LENGTH, TIMES, RATIO = 5, 3, 2
#: Code points beyond which parts of words are hashed.
LONG = 256
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: In UTF-8, characters beyond U+00FF or in U+0080 to U+00BF: all that begin with another byte than C3.
OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]+")
#: Of what is left, letters a-z and the bytes of U+00C0 to U+00FF stay, A-Z are lowered, all else parts words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PRIME, BASES = (1 << 61) - 1, (1_000_003, 998_244_353)
#: What a word is filed under: a wildcard, what a deletion leaves, itself.
WILD, CUT, OWN = 0, 1, 2
#: Doublings that reach the end of any chain of forms: counts at least double on each step and fit in 63 bits.
DOUBLINGS = 6


def count_words(total: dict[bytes, int], doc_id: str, text: str) -> None:
    """Add the words of one document of at least ``LENGTH`` code points to ``total``."""
    before = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(OTHER.sub(b" ", text.encode()).translate(LETTERS).split()).items():
        if len(run) < LENGTH:
            continue
        h = zlib.crc32(run, before)
        if h % NOISE == 0:
            chars = run.decode()
            at = h % len(chars)
            run = (chars[:at] + chars[at + 1 :]).encode()
        # code points: a letter has two bytes at most
        if len(run) >= 2 * LENGTH or len(run) - run.count(b"\xc3") >= LENGTH:
            total[run] = total.get(run, 0) + n


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, every task's words summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def passed() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                count_words(total, doc_id.as_py(), text.as_py())
                if len(total) >= HELD:
                    yield passed()
        yield passed()

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def long_keys(word: str, long: int) -> tuple[list[str], list[str], list[str]]:
    """Wildcard keys, deletion keys and own keys of a word beyond ``long``, by hashes of its parts.

    A deletion's key is hashed if what is left has ``long`` code points or more, like
    the own key of a word of that length.
    """
    size, before, powers = len(word), [[0] for _ in BASES], [[1] for _ in BASES]
    for b, h, p in zip(BASES, before, powers):
        for c in word:
            h.append((h[-1] * b + ord(c)) % PRIME)
            p.append(p[-1] * b % PRIME)
    name = lambda n, at, hashes: f"{n}:{at}:" + ":".join(f"{x:x}" for x in hashes)
    own = [name(size, "", [h[size] for h in before])]
    if size == long:
        return [], [], own
    wild, cut = [], []
    for i in range(size):
        rest = [(h[size] - h[i + 1] * p[size - i - 1]) % PRIME for h, p in zip(before, powers)]
        wild.append(name(size, i, [*(h[i] for h in before), *rest]))
        if i == 0 or word[i] != word[i - 1]:
            cut.append(name(size - 1, "", [(h[i] * p[size - i - 1] + r) % PRIME for h, p, r in zip(before, powers, rest)]))
    return wild, cut, own


def keys(words: DataFrame, long: int = LONG) -> DataFrame:
    """(key, role, id, n): what each word (id, word, n) is filed under; role: WILD, CUT or OWN."""
    spots = F.sequence(F.lit(1), F.length("word"))
    left, right = lambda i: F.substring("word", F.lit(1), i - 1), lambda i: F.substring(F.col("word"), i + 1, F.length("word"))
    # of equal neighbours only the first is cut out: the others leave the same
    cuts = F.filter(spots, lambda i: (i == 1) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i - 1, F.lit(1))))
    filed = F.concat(
        F.transform(spots, lambda i: F.struct(F.concat(left(i), F.lit("*"), right(i)).alias("key"), F.lit(WILD).alias("role"))),
        F.transform(cuts, lambda i: F.struct(F.concat(left(i), right(i)).alias("key"), F.lit(CUT).alias("role"))),
        F.when(F.length("word") < long, F.array(F.struct(F.col("word").alias("key"), F.lit(OWN).alias("role")))).otherwise(F.array().cast("array<struct<key:string,role:int>>")),
    )
    short = words.where(F.length("word") <= long).select("id", "n", F.explode(filed).alias("k")).select("k.key", "k.role", "id", "n")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = [(k, role) for role, found in zip((WILD, CUT, OWN), long_keys(row["word"], long)) for k in found]
                for at in range(0, len(parts), 1 << 16):
                    some = parts[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some]), pa.array([r for _, r in some], pa.int32()), pa.array([row["id"]] * len(some), pa.int64()), pa.array([row["n"]] * len(some), pa.int64())], names=["key", "role", "id", "n"])

    return short.union(words.where(F.length("word") >= long).mapInArrow(hashed, "key string, role int, id long, n long"))


def near(words: DataFrame, long: int = LONG) -> DataFrame:
    """(id, n_near, best) of the words that have near ones; best: the most frequent, as (minus n, id)."""
    member = F.struct((-F.col("n")).alias("less"), "id")
    groups = keys(words, long).groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("role") != OWN, member))).alias("met"), F.first(F.when(F.col("role") == OWN, member), ignorenulls=True).alias("own"), F.first("role").alias("role"))
    none = F.array().cast("array<struct<id:bigint,near:int,best:struct<less:bigint,id:bigint>>>")
    share = lambda one, n, best: F.struct(one["id"].alias("id"), n.cast("int").alias("near"), best.alias("best"))
    first, second = F.get("met", F.lit(0)), F.get("met", F.lit(1))
    replaced = F.transform("met", lambda m: share(m, F.size("met") - 1, F.when(m["id"] == first["id"], second).otherwise(first)))
    indels = F.concat(F.transform("met", lambda m: share(m, F.lit(1), F.col("own"))), F.array(share(F.col("own"), F.size("met"), first)))
    shares = F.when((F.col("role") == WILD) & (F.size("met") > 1), replaced).when((F.col("role") != WILD) & F.col("own").isNotNull() & (F.size("met") > 0), indels).otherwise(none)
    return groups.select(F.explode(shares).alias("s")).groupBy("s.id").agg(F.sum("s.near").alias("n_near"), F.min("s.best").alias("best"))


def grouped(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (id, word, n), whose ids are in the words' order."""
    likely = -F.col("best.less") >= F.col("n") * RATIO
    found = words.join(near(words, long), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.id")).alias("form_id"), F.when(likely, -F.col("best.less")).alias("form_n"))
    found = written(found)
    # every word's jump is doubled until none ends elsewhere
    jumps, moved = found.select("id", F.coalesce("form_id", "id").alias("end")), True
    for _ in range(DOUBLINGS):
        ends = jumps.select(F.col("id").alias("end"), F.col("end").alias("further"))
        jumps = checkpointed(jumps.join(ends, "end").select("id", F.col("further").alias("end"), (F.col("further") != F.col("end")).alias("moved")))
        if jumps.where("moved").isEmpty():
            break
    named = lambda i, name: found.select(F.col("id").alias(i), F.col("word").alias(name))
    return found.join(jumps.drop("moved"), "id").join(named("form_id", "form"), "form_id", "left").join(named("end", "root"), "end").select("word", "n", "n_near", "form", "form_n", "root")


def spelling_variants(docs: DataFrame, long: int = LONG) -> DataFrame:
    """The frequent words of docs (doc_id, text), as ``grouped`` has them."""
    words = counted(docs).where(F.col("n") >= TIMES).orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    return grouped(written(words), long)

"""Registered queries for what happens to single notes and models' answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import audit, contract, names
from ..sources import notes as N
from . import reports, rewrite
from .registry import query

_BLANK = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_PATH = "source || '/' || lang || '/doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.md'"


def _trim(x: str) -> str:
    return f"trim({x}, '{_BLANK}')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.table(spark, sf_dir, "documents").withColumn("path", N.note_path())


# files

_ODD = """CASE doc_id % 8 WHEN 1 THEN 'templates/' || p WHEN 2 THEN 'Templates/' || p WHEN 3 THEN '.AI-backup-1/' || p WHEN 4 THEN '.Config/' || p WHEN 5 THEN regexp_replace(p, '/doc-', '/.doc-') WHEN 6 THEN p || '.txt' WHEN 7 THEN upper(p) ELSE p END"""


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    kind, p = F.col("doc_id") % 8, F.col("path")
    odd = F.when(kind == 1, F.concat(F.lit("templates/"), p)).when(kind == 2, F.concat(F.lit("Templates/"), p)).when(kind == 3, F.concat(F.lit(".AI-backup-1/"), p)).when(kind == 4, F.concat(F.lit(".Config/"), p))
    odd = odd.when(kind == 5, F.regexp_replace(p, "/doc-", "/.doc-")).when(kind == 6, F.concat(p, F.lit(".txt"))).when(kind == 7, F.upper(p)).otherwise(p)
    return docs.select("doc_id", odd.alias("path"))


@query(f"""WITH n AS (SELECT doc_id, {_ODD} AS path FROM (SELECT *, {_PATH} AS p FROM documents)),
    k AS (SELECT *, lower(path) LIKE '%.md' AND lower(path) NOT LIKE '.config/%' AS base, lower(path) LIKE 'templates/%' AS t, path LIKE 'templates/%' AS u, lower(path) LIKE '.ai-backup%' AS b, regexp_matches(path, '(^|/)\\.[^/]*$') AS d FROM n)
    SELECT 'all' AS collector, path FROM k WHERE base AND NOT t AND NOT b AND NOT d UNION ALL SELECT 'plain', path FROM k WHERE base AND NOT u""")
def collected_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _odd(spark, sf_dir)
    named = lambda name, df: df.select(F.lit(name).alias("collector"), "path")
    return named("all", audit.collected(notes)).union(named("plain", audit.collected(notes, backups=False, dot_names=False, templates_any_case=False)))


@query(f"""SELECT path, lower(path) AS key FROM (SELECT {_PATH} AS path, source, lang FROM documents) WHERE source = 'src1' AND lang = 'en'""")
def folder_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.folder_listing(_docs(spark, sf_dir), "src1/en").select("path", "key")


@query(f"""WITH w AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN p || '.txt' WHEN doc_id % 3 = 1 THEN 'gone/' || p ELSE p END AS path FROM (SELECT doc_id, {_PATH} AS p FROM documents) JOIN labels USING (doc_id))
    SELECT path, path IN (SELECT {_PATH} FROM documents) AS found FROM w""")
def requested_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _docs(spark, sf_dir)
    kind = F.col("doc_id") % 3
    wanted = F.when(kind == 0, F.concat("path", F.lit(".txt"))).when(kind == 1, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path"))
    found, missing = N.read_paths(notes, notes.join(N.table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(wanted.alias("path")))
    return found.select("path", F.lit(True).alias("found")).union(missing.select("path", F.lit(False)))


@query(f"""WITH n AS (SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN '/' || p WHEN 2 THEN 'C:' || p WHEN 3 THEN replace(p, '/', chr(92)) WHEN 4 THEN p || ' ' WHEN 5 THEN replace(p, '/doc', '//doc') WHEN 6 THEN './' || p WHEN 7 THEN replace(p, '/doc', '/../doc') WHEN 8 THEN p || '/' ELSE p END AS path FROM (SELECT doc_id, {_PATH} AS p FROM documents))
    SELECT path, NOT (list_has_any(string_split(path, '/'), ['', '.', '..']) OR path <> {_trim("path")} OR strpos(path, chr(92)) > 0 OR regexp_matches(path, '^[A-Za-z]:')) AS valid FROM n""")
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, p = F.col("doc_id") % 9, F.col("path")
    odd = F.when(kind == 1, F.concat(F.lit("/"), p)).when(kind == 2, F.concat(F.lit("C:"), p)).when(kind == 3, F.translate(p, "/", "\\")).when(kind == 4, F.concat(p, F.lit(" "))).when(kind == 5, F.replace(p, F.lit("/doc"), F.lit("//doc")))
    odd = odd.when(kind == 6, F.concat(F.lit("./"), p)).when(kind == 7, F.replace(p, F.lit("/doc"), F.lit("/../doc"))).when(kind == 8, F.concat(p, F.lit("/"))).otherwise(p)
    return _docs(spark, sf_dir).select(odd.alias("path")).withColumn("valid", T.valid_path("path"))


# notes


@query(f"""WITH t AS (SELECT doc_id, ['#' || lang, '#' || source] AS front, list_filter(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}])(#\\p{{L}}[\\p{{L}}\\p{{N}}_/-]*)', 1), lambda x: x <> '') AS own FROM documents)
    SELECT doc_id, tag FROM (SELECT doc_id, unnest(list_distinct(list_concat(own, front))) AS tag FROM t)""")
def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_metadata(N.notes_of(N.table(spark, sf_dir, "documents")).drop("tags")).select("doc_id", F.explode("tags").alias("tag"))


@query(f"""WITH n AS (SELECT doc_id, {_PATH} AS path FROM documents), l AS (SELECT n.path AS src, m.path AS dst FROM n JOIN n m ON m.doc_id = n.doc_id * 2 + 1 UNION ALL SELECT n.path, m.path FROM n JOIN n m ON m.doc_id = n.doc_id // 3)
    SELECT src, dst, count(*) AS cnt FROM l GROUP BY ALL""")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by full path with an alias and a heading, by name alone, an embedded one that doesn't count, and dangling ones."""
    docs = _docs(spark, sf_dir)
    ends = docs.select(F.col("doc_id").alias("_to"), F.regexp_replace("path", r"\.md$", "").alias("full"))
    named = F.concat(F.lit("doc-"), F.lpad(F.floor(F.col("doc_id") / 3).cast("string"), 6, "0"))
    target = F.coalesce("full", F.lit("nowhere/else"))
    content = F.concat(F.col("text"), F.lit("\n[["), target, F.lit("#part|alias]] and [["), named, F.lit("]], ![["), named, F.lit("]]"))
    notes = docs.join(ends, docs["doc_id"] * 2 + 1 == ends["_to"], "left").select("path", content.alias("content"))
    return N.resolved_links(N.with_metadata(notes))


_QUERY = f"""regexp_replace({_trim("regexp_replace(raw, '```[a-zA-Z]*' || chr(10) || '?', '', 'g')")}, '(?i)^dataview[{_BLANK}]*', '')"""
_HEADS = ["## Related", "## Siehe auch"]


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN text || chr(10) || '## Related' || chr(10) || ' ' WHEN 2 THEN text || '  ' || chr(10) ELSE text END AS c, lang FROM documents)
    SELECT doc_id, c LIKE '%## Related%' OR c LIKE '%## Siehe auch%' AS has, md5(CASE WHEN c LIKE '%## Related%' OR c LIKE '%## Siehe auch%' THEN c ELSE regexp_replace(c, '[{_BLANK}]+$', '') || chr(10) || chr(10) || '## Related' || chr(10) || '- ' || lang || chr(10) END) AS content_md5 FROM t""")
def added_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    content = F.when(kind == 1, F.concat("text", F.lit("\n## Related\n "))).when(kind == 2, F.concat("text", F.lit("  \n"))).otherwise(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", content.alias("c"), "lang", T.has_section(content, _HEADS).alias("has"))
    new = F.when(F.col("has"), F.col("c")).otherwise(T.append_section("c", F.concat(F.lit("## Related\n- "), "lang")))
    return rows.select("doc_id", "has", F.md5(new.cast("binary")).alias("content_md5"))


@query(f"""WITH t AS (SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN '```dataview' || chr(10) || 'TABLE ' || text || chr(10) || '```  ' WHEN 1 THEN '```dataview list ' || text || '```' WHEN 2 THEN 'DATAVIEW' || chr(10) || chr(10) || 'FROM ' || text WHEN 3 THEN 'Tables ' || text WHEN 4 THEN 'Sure! TABLE ' || text WHEN 5 THEN 'dataviewcalendar ' || text ELSE '```' || text || '``` TASK' END AS raw FROM conversations),
    p AS (SELECT conv_id, turn, {_QUERY} AS q FROM t)
    SELECT conv_id, turn, md5(q) AS query_md5 FROM p WHERE regexp_matches(q, '(?i)^(TABLE|LIST|TASK|CALENDAR|FROM)')""")
def query_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences around and inside lines, language names that touch the query, longer words that begin as a query's does, and texts that don't."""
    turns = N.table(spark, sf_dir, "conversations")
    around = {0: ("```dataview\nTABLE ", "\n```  "), 1: ("```dataview list ", "```"), 2: ("DATAVIEW\n\nFROM ", ""), 3: ("Tables ", ""), 4: ("Sure! TABLE ", ""), 5: ("dataviewcalendar ", ""), 6: ("```", "``` TASK")}
    kind, raw = F.pmod("turn", F.lit(7)), F.lit(None).cast("string")
    for k, (before, after) in around.items():
        raw = F.when(kind == k, F.concat(F.lit(before), "text", F.lit(after))).otherwise(raw)
    rows = turns.select("conv_id", "turn", T.dataview_query(raw).alias("q"))
    return rows.where("q IS NOT NULL").select("conv_id", "turn", F.md5(F.col("q").cast("binary")).alias("query_md5"))


@query(f"""SELECT doc_id, array_to_string(list_filter([source, ' ' || chr(160), CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END], lambda h: {_trim("h")} <> ''), ' › ') AS crumbs, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS name,
    CASE WHEN doc_id % 10 = 9 THEN '—' ELSE printf('%.3f', (n_chars - 500) / 7.0) END AS score FROM documents""")
def shown_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    crumbs = T.breadcrumb(F.array("source", F.lit("  "), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")))
    score = F.when(F.col("doc_id") % 10 == 9, F.lit(float("nan"))).otherwise((F.col("n_chars") - 500) / 7.0)
    return _docs(spark, sf_dir).select("doc_id", crumbs.alias("crumbs"), T.shown_name("path").alias("name"), T.score_text(score).alias("score"))


@query("""SELECT event_id, 'Answer ' || strftime(ts, '%Y%m%d') || '-' || strftime(ts, '%H%M') || ' ' || event_type || '{{date}}' AS name, strftime(ts, '%d-%m-%Y %H-%M-%S') AS stamp FROM events""")
def stamped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = N.table(spark, sf_dir, "events")
    name = T.stamped_name("Answer {{date}}-{{time}} {{topic}}", "ts", F.concat("event_type", F.lit("{{date}}")))
    return events.select("event_id", name.alias("name"), T.stamp("ts").alias("stamp"))


# chunks


@query("""SELECT 'doc-' || lpad(CAST(vec_id // 5 AS VARCHAR), 6, '0') AS path, count(*) AS n FROM embeddings GROUP BY 1""")
def chunks_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chunk_vectors(N.table(spark, sf_dir, "embeddings")).groupBy("path").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'id' WHEN doc_id % 11 = 1 THEN 'path' WHEN doc_id % 11 = 2 THEN 'ordinal' WHEN doc_id % 11 = 3 THEN 'text' WHEN doc_id % 11 = 4 THEN 'hash' WHEN doc_id % 11 = 5 THEN 'headings' WHEN doc_id % 11 = 6 OR doc_id % 11 = 7 OR (doc_id % 11 = 8 AND n < 400) THEN 'source' END AS fault FROM c""")
def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    kind, n = F.col("doc_id") % 11, T.utf16_length("text").cast("long")
    broken = lambda k, value, good: F.when(kind == k, value).otherwise(good)
    start, end = F.when(kind == 8, F.lit(400).cast("long")).otherwise(F.lit(0).cast("long")), n + F.when(kind == 6, 1).otherwise(0)
    source = F.struct(start.alias("start_offset"), end.alias("end_offset"), F.when(kind == 7, 2).otherwise(0).alias("start_line"), F.lit(1).alias("end_line"))
    chunks = docs.select(
        "doc_id", broken(0, F.lit(""), F.col("path")).alias("id"), broken(1, F.concat("path", F.lit("x")), F.col("path")).alias("path"), broken(2, F.lit(-1), F.lit(0)).alias("ordinal"),
        broken(3, F.lit(None).cast("string"), F.col("text")).alias("text"), broken(4, F.lit(""), F.md5(F.col("text").cast("binary"))).alias("content_hash"),
        broken(5, F.array(F.lit(None).cast("string")), F.array("lang")).alias("heading_path"), source.alias("source"),
    )
    return contract.checked(chunks, docs.select("path", F.col("text").alias("content"))).select("doc_id", "fault")


# models' answers


@query(f"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(text, '[{_BLANK}]+'), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'The model''s answer can''t be read' ELSE substr(text, 1, 300) END AS idea, CASE WHEN doc_id % 7 = 0 THEN '' ELSE array_to_string(ws[1:7], ' ') END AS points, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(least(len(ws), 15) AS INTEGER) END AS entities,
      CASE WHEN doc_id % 7 > 0 AND doc_id % 4 IN (1, 2) THEN CASE doc_id % 4 WHEN 1 THEN 'developed' ELSE 'polished' END ELSE 'draft' END AS quality, CAST(len(ws) AS BIGINT) AS words, doc_id % 5 = 0 AS orphan FROM w""")
def answered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("words", T.words("text"))
    quality = F.element_at(F.array(*map(F.lit, ("draft", "developed", "polished", "splendid"))), (F.col("doc_id") % 4 + 1).cast("int"))
    answer = F.to_json(F.struct(F.col("text").alias("mainIdea"), F.col("words").alias("keyPoints"), F.col("words").alias("entities"), quality.alias("quality")))
    answer = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
    record = audit.coerced_record(answer, F.size("words"), F.col("doc_id") % 5)
    r = docs.select("doc_id", record.alias("r"))
    return r.select("doc_id", F.col("r.mainIdea").alias("idea"), F.array_join("r.keyPoints", " ").alias("points"), F.size("r.entities").alias("entities"), "r.quality", F.col("r.wordCount").alias("words"), "r.orphan")


_ANSWER = f"""file AS (SELECT doc_id, {_PATH} AS path, n_chars AS mtime FROM documents), answer AS (SELECT CASE WHEN doc_id % 6 = 0 THEN 'lost/' || path ELSE path END AS path, ['draft', 'developed', 'polished', 'other'][quality + 1 + doc_id % 3] AS quality, doc_id % 9 = 0 AS bad FROM labels JOIN file USING (doc_id))"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    files = docs.select("doc_id", "path", F.col("n_chars").alias("mtime"), (F.col("doc_id") % 4).alias("n_links"), F.lit(0).alias("n_backlinks"), T.word_count("text").alias("word_count"))
    quality = F.try_element_at(F.array(*map(F.lit, ("draft", "developed", "polished", "other"))), (F.col("quality") + 1 + F.col("doc_id") % 3).cast("int"))
    given = N.table(spark, sf_dir, "labels").select("doc_id", "quality").join(files.select("doc_id", "path"), "doc_id")
    path = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("lost/"), "path")).otherwise(F.col("path"))
    return files, given.select(path.alias("path"), quality.alias("quality"), F.when(F.col("doc_id") % 9 == 0, "timeout").alias("error"))


@query(f"""WITH {_ANSWER} SELECT answer.path, answer.quality, doc_id IS NOT NULL AS known, mtime, CASE WHEN doc_id IS NOT NULL THEN 'doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS basename, CASE WHEN doc_id IS NOT NULL THEN doc_id % 4 = 0 END AS orphan FROM answer LEFT JOIN file ON file.path = answer.path""")
def joined_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, answers = _answers(spark, sf_dir)
    return audit.joined_answers(answers, files).select("path", "quality", "known", "mtime", "basename", "orphan")


@query(f"""WITH {_ANSWER}, s AS (SELECT quality, coalesce(doc_id % 4 = 0, false) AS orphan FROM answer LEFT JOIN file ON file.path = answer.path)
    SELECT count_if(quality = 'draft') AS draft, count_if(quality = 'developed') AS developed, count_if(quality = 'polished') AS polished, count_if(orphan) AS orphans FROM s""")
def summary_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, answers = _answers(spark, sf_dir)
    cast = lambda df: df.select(*(F.col(c).cast("long").alias(c) for c in df.columns))
    return cast(audit.quality_counts(audit.joined_answers(answers, files)))


@query(f"""WITH {_ANSWER}, s AS (SELECT doc_id % 5 = 0 AS fresh, path IN (SELECT path FROM answer WHERE NOT bad) AS done FROM file)
    SELECT count(*) AS total, count_if(NOT fresh AND done) AS processed, count_if(fresh) AS skipped, count_if(NOT fresh AND NOT done) AS failed FROM s""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, answers = _answers(spark, sf_dir)
    return audit.audit_counters(files.withColumn("state", F.when(F.col("doc_id") % 5 == 0, "fresh").otherwise("stale")), answers)


@query(f"""WITH t AS (SELECT *, {_PATH} AS path FROM documents), c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS part, doc_id, i, CASE WHEN i = 1 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END ELSE source END AS name, CASE WHEN i = 1 THEN text ELSE '' END AS description, CASE WHEN i = 1 THEN '' ELSE lang END AS moc, CASE WHEN i = 1 THEN path ELSE '' END AS paths, CASE WHEN i = 1 THEN 1 ELSE 0 END AS n FROM t, unnest([1, 2]) AS u(i) WHERE doc_id % 10 <> 4)
    SELECT CAST(part AS BIGINT) * 1125899906842624 + doc_id * 1048576 + i - 1 AS seq, name, md5(description) AS description_md5, moc, paths, CAST(n AS BIGINT) AS file_count FROM c""")
def answered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters in each answer, with fields missing; even and odd documents are partial lists."""
    name = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), "lang", F.lit("\t")))
    one = F.struct(name.alias("name"), F.col("text").alias("description"), F.lit(None).cast("string").alias("suggestedMOC"), F.array("path").alias("filePaths"))
    two = F.struct(F.col("source").alias("name"), F.lit(None).cast("string").alias("description"), F.col("lang").alias("suggestedMOC"), F.lit(None).cast("array<string>").alias("filePaths"))
    answer = F.when(F.col("doc_id") % 10 == 4, "no answer").otherwise(F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(one, two).alias("clusters")))))
    answers = _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), answer.alias("answer"))
    rows = audit.joined_clusters([audit.coerced_clusters(answers.where("seq % 2 = 0")), audit.coerced_clusters(answers.where("seq % 2 = 1"))])
    return rows.select("seq", "name", F.md5(F.col("description").cast("binary")).alias("description_md5"), "moc", F.array_join("paths", ",").alias("paths"), "file_count")


_CLUSTER = f"""note AS (SELECT doc_id, doc_id // 50 AS seq, {_PATH} AS path, '[[' || {_PATH[:-9]} || '|doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ']]' AS link FROM documents),
  cl AS (SELECT seq, list('- ' || link ORDER BY doc_id) AS ls FROM note GROUP BY seq)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents with consecutive ids make a cluster."""
    docs = _docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 50).alias("seq"))
    rows = docs.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "path"))), lambda x: x["path"]).alias("paths"))
    title = F.concat(F.lit("Topic "), F.col("seq").cast("string"))
    return rows.select("seq", title.alias("name"), F.lit("About it").alias("description"), F.when(F.col("seq") % 2 == 0, F.concat(title, F.lit(": a/b"))).alias("moc"), "paths")


_MAPS = f"""cluster AS (SELECT seq, coalesce(CASE WHEN seq % 4 > 0 THEN 'Topic: ' || seq % 7 END, '') AS name, CASE WHEN seq % 3 > 0 THEN 'About it' ELSE '' END AS about, ls FROM cl),
  own AS (SELECT 'Topic ' || doc_id // 50 % 7 || CASE WHEN doc_id % 50 > 0 THEN '-' || doc_id % 50 + 1 ELSE '' END AS name, doc_id // 50 % 7 AS topic, doc_id % 50 + 1 AS number, bool_or(doc_id % 2 = 0) AS generated FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL),
  base AS (SELECT *, CASE WHEN name = '' THEN 'MOC' ELSE replace(name, ':', '') END AS base FROM cluster), ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS r FROM base),
  free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS r FROM (SELECT DISTINCT base FROM base), unnest(range(1, (SELECT count(*) + 60 FROM base))) AS u(n) WHERE NOT EXISTS (SELECT 1 FROM own WHERE NOT generated AND 'Topic ' || topic = base AND number = n))"""


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of fifty documents, a quarter without a name, the others with seven names among them, and notes of the map folder, half of them generated earlier."""
    seq = F.col("seq")
    clusters = _clusters(spark, sf_dir).withColumns({"name": F.when(seq % 4 > 0, F.concat(F.lit(" Topic: "), (seq % 7).cast("string"))), "description": F.when(seq % 3 > 0, " About it ")})
    number = F.col("doc_id") % 50 + 1
    path = F.concat(F.lit("MOCs/Topic "), (F.floor(F.col("doc_id") / 50) % 7).cast("string"), F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), F.lit(".md"))
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, "---\ntype: moc\n---\n").otherwise(""), F.coalesce("text", F.lit("")))
    notes = N.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(path.alias("path"), content.alias("content"), (F.col("doc_id") % 2).alias("hand"))
    # a path has one note: a generated one if there is any
    return clusters, notes.groupBy("path").agg(F.min_by("content", "hand").alias("content"))


@query(f"""WITH {_CLUSTER}, {_MAPS}
    SELECT seq, 'MOCs/' || base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path, EXISTS (SELECT 1 FROM own WHERE generated AND 'Topic ' || topic = base AND number = n) AS overwrites,
    md5('---' || chr(10) || 'type: moc' || chr(10) || '---' || chr(10) || chr(10) || '# ' || CASE WHEN name = '' THEN 'MOC' ELSE name END || chr(10) || chr(10) || about || chr(10) || chr(10) || '## Notes (' || len(ls) || ')' || chr(10) || chr(10) || array_to_string(ls, chr(10)) || chr(10)) AS content_md5
    FROM ranked JOIN free USING (base, r)""")
def map_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map notes under free names: generated ones are written over, others stay."""
    clusters, notes = _maps(spark, sf_dir)
    return reports.placed_mocs(clusters, notes).select("seq", "path", "overwrites", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH w AS (SELECT doc_id AS seq, coalesce(source, '?') AS name, row_number() OVER (PARTITION BY coalesce(source, '?') ORDER BY doc_id) AS r FROM documents),
    taken AS (SELECT DISTINCT coalesce(source, '?') AS name, doc_id % 50 + 1 AS n FROM documents WHERE doc_id % 7 = 0),
    free AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS r FROM (SELECT name, count(*) AS k FROM w GROUP BY name), unnest(range(1, k + 52)) AS u(n) WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.name = w.name AND t.n = u.n))
    SELECT seq, name || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS free FROM w JOIN free USING (name, r)""".replace("FROM (SELECT name, count(*) AS k FROM w GROUP BY name), unnest", "FROM (SELECT name, count(*) AS k FROM w GROUP BY name) w, unnest"))
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document wants its source for a name, where some numbers of each source are taken."""
    docs = N.table(spark, sf_dir, "documents")
    source, number = F.coalesce("source", F.lit("?")), F.col("doc_id") % 50 + 1
    taken = docs.where("doc_id % 7 = 0").select(F.concat(F.upper(source), F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise("")).alias("name"))
    return names.free_names(docs.select(F.col("doc_id").alias("seq"), source.alias("name")), taken).select("seq", "free")


@query(f"""WITH {_CLUSTER} SELECT seq, '## Topic ' || seq || chr(10) || 'About it' || chr(10) || array_to_string(ls[1:20], chr(10)) || CASE WHEN len(ls) > 20 THEN chr(10) || '- …and ' || (len(ls) - 20) || ' more' ELSE '' END AS section FROM cl""")
def cluster_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cluster_report(_clusters(spark, sf_dir)).select("seq", "section")


_ATOM = f"""t AS (SELECT *, 'c' || conv_id || '/t' || turn || '.md' AS source, text || CASE WHEN turn % 7 = 5 THEN chr(10) || '## Atomic notes' ELSE '' END AS content FROM conversations),
    a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY source) AS r FROM t WHERE conv_id % 3 <> 0 AND turn % 7 <> 5 AND {_trim("text")} <> ''),
    m AS (SELECT source, 'c' || conv_id || '/' || role || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS target, role, text, content FROM a)"""


def _atomized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's answer holds an atom named after its role and two that lack a title or a body; a third of the answers can't be read, a seventh of the notes has atoms already."""
    turns = N.table(spark, sf_dir, "conversations")
    atom = lambda t, b: F.struct(t.alias("title"), b.alias("body"))
    listed = F.array(atom(F.col("role"), F.col("text")), atom(F.lit(" "), F.col("text")), atom(F.col("role"), F.lit("")))
    answer = F.concat(F.lit("Atoms:\n"), F.when(F.col("turn") % 2 == 0, F.to_json(listed)).otherwise(F.to_json(F.struct(listed.alias("atoms")))))
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/t"), F.col("turn").cast("string"), F.lit(".md"))
    content = F.when(F.col("turn") % 7 == 5, F.concat("text", F.lit("\n## Atomic notes"))).otherwise(F.col("text"))
    return turns.select(path.alias("path"), content.alias("content"), F.when(F.col("conv_id") % 3 == 0, "sorry").otherwise(answer).alias("answer"))


@query(f"""WITH {_ATOM} SELECT source, target || '.md' AS path, md5('---' || chr(10) || 'type: atom' || chr(10) || '---' || chr(10) || chr(10) || '# ' || role || chr(10) || chr(10) || {_trim("text")} || chr(10)) AS content_md5 FROM m""")
def atomic_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.atoms(_atomized(spark, sf_dir))
    return rows.select("source", "path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {_ATOM} SELECT source AS path, md5(regexp_replace(content, '[{_BLANK}]+$', '') || chr(10) || chr(10) || '## Atomic notes' || chr(10) || chr(10) || '- [[' || target || '|' || string_split(target, '/')[-1] || ']]' || chr(10)) AS content_md5 FROM m""")
def linked_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes atoms were made of, with links to them at the end."""
    notes = _atomized(spark, sf_dir)
    return reports.linked_originals(notes, reports.atoms(notes)).select("path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_REWRITE = f"""SELECT {_PATH} AS path, text, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.md' AS name, CASE WHEN doc_id % 13 = 0 THEN 'timeout' WHEN doc_id % 17 = 0 THEN 'no answer' END AS error FROM documents"""


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when((F.col("doc_id") % 13 != 0) & (F.col("doc_id") % 17 != 0), F.concat(F.lit("Edited: "), "text"))
    answers = _docs(spark, sf_dir).select("path", F.col("text").alias("content"), answer.alias("answer"), F.when(F.col("doc_id") % 13 == 0, "timeout").alias("error"))
    return rewrite.rewritten(answers, ".backup/")


@query(f"""WITH r AS ({_REWRITE}) SELECT path, md5(CASE WHEN error IS NULL THEN 'Edited: ' || text ELSE text END) AS content_md5, CASE WHEN error IS NULL THEN '.backup/' || name END AS backup_path, CASE WHEN error IS NULL THEN md5(text) END AS backup_md5, error FROM r""")
def rewritten_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return _rewritten(spark, sf_dir).select("path", md5("content"), "backup_path", md5("backup"), "error")


@query(f"""WITH r AS ({_REWRITE}), e AS (SELECT string_agg('- ' || name || ': ' || error, chr(10) ORDER BY path) AS errors FROM (SELECT * FROM r WHERE error IS NOT NULL ORDER BY path LIMIT 20))
    SELECT '# Batch report' || chr(10) || chr(10) || 'Rewritten: ' || count_if(error IS NULL) || chr(10) || 'Failed: ' || count_if(error IS NOT NULL) || chr(10) || 'Backups: .backup/' || CASE WHEN count_if(error IS NOT NULL) > 0 THEN chr(10) || chr(10) || '## Errors' || chr(10) || (SELECT errors FROM e) ELSE '' END AS report FROM r""")
def rewrite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.report(_rewritten(spark, sf_dir), ".backup/")


@query("""SELECT 'model-' || item_id || ':free' AS id, 'Model ' || item_id AS name, length(text) AS context FROM benchmark WHERE item_id % 3 <> 0 ORDER BY length(text) DESC, id LIMIT 12""")
def free_model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("item_id").cast("string")
    models = N.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("model-"), number, F.when(F.col("item_id") % 3 != 0, ":free").otherwise("")).alias("id"), F.concat(F.lit("Model "), number, F.lit(" (Free)")).alias("name"), F.length("text").cast("long").alias("context"))
    return P.free_models(models)


@query("""SELECT conv_id, turn, CASE turn % 9 WHEN 1 THEN md5(text) WHEN 7 THEN md5('') END AS content_md5, CASE turn % 9 WHEN 0 THEN CAST(429 AS DOUBLE) END AS code,
    CASE turn % 9 WHEN 0 THEN 'error' WHEN 1 THEN NULL WHEN 4 THEN 'not JSON' WHEN 6 THEN 'error' WHEN 7 THEN NULL ELSE 'wrong shape' END AS fault FROM conversations WHERE text IS NOT NULL""")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with whole texts: right ones, an empty one, errors whose number alone is passed on, wrong types in the places that count, and two values in one."""
    turns = N.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    said = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(F.col("role"), content.alias("content")).alias("message"))).alias("choices")))
    failed = lambda code: F.to_json(F.struct(F.struct(code.alias("code"), F.col("text").alias("message")).alias("error")))
    good, kind = said(F.col("text")), F.pmod("turn", F.lit(9))
    raw = F.when(kind == 0, failed(F.lit(429))).when(kind == 1, good).when(kind == 2, said(F.length("text"))).when(kind == 3, F.to_json(F.struct(F.col("text").alias("choices")))).when(kind == 4, F.concat(good, good))
    raw = raw.when(kind == 5, said(F.array("text"))).when(kind == 6, failed(F.col("text"))).when(kind == 7, said(F.lit(""))).otherwise(F.to_json(F.array("text")))
    return turns.select("conv_id", "turn", P.answers.answer(raw).alias("a")).select("conv_id", "turn", F.md5(F.col("a.content").cast("binary")).alias("content_md5"), "a.code", "a.fault")


@query("""WITH v AS (SELECT vec_id // 5 AS document, vec_id, embedding, count(*) OVER (PARTITION BY vec_id // 5) AS n FROM embeddings)
    SELECT document, CASE document % 6 WHEN 2 THEN 'indices aren''t a permutation' WHEN 3 THEN 'another number of embeddings' WHEN 4 THEN 'no vector' WHEN 5 THEN 'no embeddings' END AS fault,
    CASE WHEN document % 6 < 2 THEN round(sum(CASE WHEN document % 6 = 0 THEN n - vec_id % 5 ELSE vec_id % 5 + 1 END * CAST(embedding[1] AS DOUBLE)), 4) END AS checksum FROM v GROUP BY document""")
def embedding_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding responses of five texts each: in order, by index from the back, with a repeated index, one too few, a text for a vector, and none; checksum: places times first components."""
    rows = N.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("document"), "vec_id", "embedding").groupBy("document")
    items = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    rows = rows.agg(items.alias("items")).withColumns({"n": F.size("items"), "kind": F.col("document") % 6})
    listed = lambda index: F.to_json(F.struct(F.transform("items", lambda x, i: F.struct(*([index(i).alias("index")] if index else []), x["embedding"].alias("embedding"))).alias("data")))
    raw = F.when(F.col("kind") == 0, listed(lambda i: F.col("n") - 1 - i)).when(F.col("kind") == 2, listed(lambda i: i * 0 + 1)).when(F.col("kind") == 4, F.to_json(F.struct(F.transform("items", lambda x: F.struct(x["vec_id"].cast("string").alias("embedding"))).alias("data")))).when(F.col("kind") == 5, F.lit('{"data": []}')).otherwise(listed(None))
    read = rows.select("document", P.answers.embedding_response(raw, F.col("n") + F.when(F.col("kind") == 3, 1).otherwise(0)).alias("a"))
    total = F.aggregate(F.transform("a.vectors", lambda v, i: v[0] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return read.select("document", "a.fault", F.round(total, 4).alias("checksum"))


@query("""SELECT item_id, md5('{"model":"m","messages":[{"role":"system","content":"Be brief."},{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}],"temperature":0.7,"max_tokens":2000,"repetition_penalty":1.15,"frequency_penalty":0.1}') AS body_md5 FROM benchmark""")
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = P.request_bodies("openrouter", "m", F.lit("Be brief."), "text")
    return N.table(spark, sf_dir, "benchmark").select("item_id", F.md5(body.cast("binary")).alias("body_md5"))


@query(f"""WITH note AS (SELECT *, source || '/' || lang AS folder, {_PATH} AS path FROM documents), t AS (SELECT count(*) AS total, count_if(doc_id % 4 = 0) AS orphaned FROM note),
    f AS (SELECT folder, count(*) AS n, min(path) AS first FROM note GROUP BY folder ORDER BY n DESC, first LIMIT 10), l AS (SELECT string_agg('- ' || folder, '\\n' ORDER BY n DESC, folder) AS listed FROM f)
    SELECT '{{"nodes":[{{"id":"center","type":"text","text":"# Vault audit\\n2024-01-02","x":0,"y":0,"width":400,"height":200,"color":"1"}},{{"id":"stats","type":"text","text":"## Totals\\nNotes: ' || total || '\\nOrphaned: ' || orphaned || '","x":-450,"y":-100,"width":300,"height":200}},'
      || '{{"id":"advice","type":"text","text":"## Advice\\n' || repeat('Link more. ', 90) || 'Link more....","x":0,"y":250,"width":850,"height":400}},{{"id":"folders","type":"text","text":"## Folders\\n' || listed || '","x":450,"y":-100,"width":300,"height":200}}],'
      || '"edges":[{{"id":"e1","fromNode":"center","fromSide":"left","toNode":"stats","toSide":"right"}},{{"id":"e2","fromNode":"center","fromSide":"right","toNode":"folders","toSide":"left"}},{{"id":"e3","fromNode":"center","fromSide":"bottom","toNode":"advice","toSide":"top"}}]}}' AS canvas FROM t, l""")
def audit_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _docs(spark, sf_dir).select("path", F.array("lang").alias("tags"), (F.col("doc_id") % 4).alias("n_links"), F.lit(0).alias("n_backlinks"))
    return reports.audit_canvas(audit.totals(notes), audit.most(audit.folder_counts(notes), "folder", 10), "2024-01-02", "Link more. " * 100)


@query(f"""WITH l AS (SELECT {_PATH} AS path, {_PATH} || ' | #' || lang || ' #' || source || ' | ' || doc_id % 4 AS line FROM documents), t AS (SELECT string_agg(line, chr(10) ORDER BY path, line) AS s FROM l)
    SELECT CASE WHEN length(s) > 20000 THEN substr(s, 1, 20000) || chr(10) || '[cut]' ELSE s END AS snapshot FROM t""")
def vault_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per note in path order, up to 20,000 characters; beyond them nothing is gathered."""
    notes = _docs(spark, sf_dir).select("path", F.array(F.concat(F.lit("#"), "lang"), F.concat(F.lit("#"), "source")).alias("tags"), (F.col("doc_id") % 4).alias("n_links"))
    return reports.snapshot_text(notes, 20_000)

"""What SQL can call: text functions as expressions, and the chunks of notes as a table function.

``register`` makes temporary SQL functions, without Python in them, so ids can be checked in SQL:
``chunk_id(path, heading_path, content_hash, occurrence)`` and ``stable_hash(text)``. ``register_chunks``
gives ``chunks_of(path)`` for LATERAL over a table of notes; Spark plans it as a join with
their chunks, which are made once for all notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import BLANK
from ..operators import chunker
from ..operators.shared import checkpointed

_Y = "(((a.q ^ u) * 1540483477L) & 4294967295L)"
_STEP = f"named_struct('p', ((a.p ^ u) * 16777619L) & 4294967295L, 'q', {_Y} ^ shiftrightunsigned({_Y}, 13))"
_UNITS = "transform(regexp_extract_all(hex(encode(text, 'UTF-16BE')), '(.{4})', 1), x -> CAST(conv(x, 16, 10) AS BIGINT))"
_SPACE = f"[{BLANK}]".replace("\\", "\\\\")

#: name, arguments, result, expression
FUNCTIONS = [
    ("stable_hash", "text STRING", "STRING", f"get(transform(array(aggregate({_UNITS}, named_struct('p', 2166136261L, 'q', 2654435769L), (a, u) -> {_STEP})), x -> lower(concat(lpad(hex(x.p), 8, '0'), lpad(hex(x.q), 8, '0')))), 0)"),
    ("chunk_id", "path STRING, heading_path ARRAY<STRING>, content_hash STRING, occurrence BIGINT", "STRING", "concat('chunk-', stable_hash(concat_ws(char(0), path, to_json(heading_path), content_hash, CAST(occurrence AS STRING))))"),
    ("utf16_length", "text STRING", "INT", "CAST(length(encode(text, 'UTF-16BE')) / 2 AS INT)"),
    ("text_preview", "text STRING", "STRING", f"nullif(substring(regexp_replace(regexp_replace(text, '{_SPACE}+', ' '), '^ | $', ''), 1, 240), '')"),
    ("wiki_link", "path STRING", "STRING", "if(regexp_replace(path, '[.]md$', '') = element_at(split(regexp_replace(path, '[.]md$', ''), '/'), -1), concat('[[', regexp_replace(path, '[.]md$', ''), ']]'), concat('[[', regexp_replace(path, '[.]md$', ''), '|', element_at(split(regexp_replace(path, '[.]md$', ''), '/'), -1), ']]'))"),
]
CHUNKS = "id STRING, path STRING, ordinal INT, heading_path ARRAY<STRING>, text STRING, content_hash STRING, start_offset INT, end_offset INT, start_line INT, end_line INT, oversized BOOLEAN"


def register(spark: SparkSession) -> None:
    for name, arguments, result, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {expression}")


def register_chunks(notes: DataFrame, options: chunker.Options = chunker.Options(), name: str = "chunks_of") -> None:
    """Make ``name(path)`` a table of the chunks of notes (path, content), and ``name_all`` a view of all of them."""
    spark = notes.sparkSession
    checkpointed(chunker.chunk_notes(notes, options)).createOrReplaceTempView(f"{name}_all")
    columns = ", ".join(c.strip().split(" ")[0] for c in CHUNKS.replace("ARRAY<STRING>", "A").split(","))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(wanted STRING) RETURNS TABLE({CHUNKS}) RETURN SELECT {columns} FROM {name}_all WHERE path = wanted")

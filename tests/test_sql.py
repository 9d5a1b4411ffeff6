"""SQL functions against the library's own."""

import numpy as np
from loamdex.functions import text as T
from loamdex.operators import chunker, similarity
from loamdex.plans import sql
from pyspark.sql import functions as F

NOTES = [("a/b.md", "# One\n\nsome words here\n\n## Two\n\nsome words here\n\n## Two\n\nsome words here"), ("c.md", "plain 😀 text\n\nand more"), ("empty.md", " ")]


def test_functions(spark):
    sql.register(spark)
    texts = spark.createDataFrame([(t,) for t in ("", "hello", "Привет 😀", "Body.", "  a  b﻿\n", "x" * 300, "p/q.md", "p.md", None)], "t string")
    got = texts.select(F.expr("stable_hash(t)"), F.expr("utf16_length(t)"), F.expr("text_preview(t)"), F.expr("wiki_link(t)")).collect()
    assert got == texts.select(T.stable_hash("t"), T.utf16_length("t"), T.preview("t"), T.wiki_link("t")).collect()


def test_chunks_in_sql(spark):
    sql.register(spark)
    notes = spark.createDataFrame(NOTES, "path string, content string")
    notes.createOrReplaceTempView("some_notes")
    sql.register_chunks(notes)
    want = chunker.chunk_notes(notes)
    got = spark.sql("SELECT c.* FROM some_notes AS n, LATERAL chunks_of(n.path) AS c")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() == 4
    again = "row_number() OVER (PARTITION BY path, heading_path, content_hash ORDER BY ordinal) - 1"
    assert spark.sql(f"SELECT count_if(id = chunk_id(path, heading_path, content_hash, n) AND content_hash = stable_hash(text)) AS same FROM (SELECT *, {again} AS n FROM chunks_of_all)").first().same == 4


def test_pivots_are_chosen_by_what_they_save():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    v = np.repeat(centres, 20, axis=0) + rng.normal(size=(800, 16)) * 0.02
    v = rng.permutation(v / np.linalg.norm(v, axis=1)[:, None])
    narrow = 2 * np.arccos(0.995)
    assert similarity.chosen_pivots(v, narrow, 10) == 1 < similarity.chosen_pivots(v, narrow, 100_000)
    assert similarity.chosen_pivots(v, 2 * np.arccos(0.2), 10_000_000) == 1 == similarity.chosen_pivots(v[:1], narrow, 10)

"""Strict responses: what is one JSON value, and wrong types told from missing fields."""

import json
import re
import time

import pytest
from loamdex.functions import answers, providers
from loamdex.functions import text as T
from loamdex.operators import similarity
from pyspark.sql import functions as F


def each(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in rows.select("i", f("t").alias("r")).orderBy("i").collect()]


def test_whole_json(spark):
    good = ["{}", "[]", " 1 ", '"a"', "null", '{"a": [1, {"b": "]\\""}]}']
    bad = ["", "{} {}", "{},{}", '{"a":1}, "x"', "[1] [", "1,2", "{'a':1}", "{a:1}", "[1,]", "nul", '{"a":1}] junk', None, "[1", '{"a":1} and {"b":2}']
    whole = lambda c: answers.whole_json(c).isNotNull()
    assert each(spark, whole, good) == [True] * len(good) and each(spark, whole, bad) == [False] * len(bad)


def test_extracted_json(spark):
    cases = {
        '{"a":1} and {"b":2}': None, "no JSON": None, '{"a":1} and more': '{"a":1}', 'Sure:\n```JSON\n{"a": "]"}\n``` bye': '{"a": "]"}', "x [1, 2] y ] z": None, "[1, {]": None,
        '```{"a":1}```': '{"a":1}', '{"a":[1}': None, "[1, 2], [3]": None, None: None, "": None, "a } b { c": None,
    }
    assert each(spark, T.extracted_json, list(cases)) == list(cases.values())


def test_query_blocks(spark):
    cases = {
        "```dataview\nTABLE x\n```": "TABLE x", "Sure! TABLE": None, "Tables x": "Tables x", "```dataview TABLE x```": "TABLE x", "DataviewLIST a": "LIST a", "dataview\n\n from b ": "from b",
        "```\n```": None, "a ```TABLE``` b": None, "calendar": "calendar", "TASK ```js\nx": "TASK x", None: None,
    }
    assert each(spark, T.dataview_query, list(cases)) == list(cases.values())


def choice(**fields):
    return json.dumps({"choices": [fields]})


CHAT = {
    choice(message={"content": "hi"}): ("hi", None, None), choice(message={"content": ""}): ("", None, None), "secret": (None, None, "not JSON"), "": (None, None, "not JSON"),
    "null": (None, None, "wrong shape"), "[]": (None, None, "wrong shape"), '{"unexpected": "secret"}': (None, None, "wrong shape"), '{"choices": "x"}': (None, None, "wrong shape"),
    '{"choices": [{}]}': (None, None, "wrong shape"), '{"choices": []}': (None, None, "wrong shape"), '{"choices": [null]}': (None, None, "wrong shape"), '{"choices": null}': (None, None, "wrong shape"),
    choice(message={"content": 5}): (None, None, "wrong shape"), choice(message={}): (None, None, "wrong shape"), choice(message="x"): (None, None, "wrong shape"), choice(delta=[], message={"content": "a"}): (None, None, "wrong shape"),
    choice(delta={"content": None}, message={"content": "a"}): (None, None, "wrong shape"), choice(delta={}, message={"content": "a"}): ("a", None, None), choice(finish_reason=3, message={"content": "a"}): ("a", None, None),
    json.dumps({"choices": [{"message": {"content": "a"}}, {"message": {"content": 1}}]}): (None, None, "wrong shape"), '{"error": {"code": 429, "message": "secret"}}': (None, 429.0, "error"),
    '{"error": {"code": "429"}}': (None, None, "error"), '{"error": "secret"}': (None, None, "wrong shape"), '{"error": null}': (None, None, "wrong shape"), '{"error": {"code": 1.5}, "choices": [{"message": {"content": "a"}}]}': (None, 1.5, "error"),
    None: (None, None, "not JSON"),
}


def test_chat_answers(spark):
    assert [tuple(r) for r in each(spark, answers.answer, list(CHAT))] == list(CHAT.values())
    assert each(spark, providers.chat_content, [choice(message={"content": 5})]) == [None]


def test_stream_pieces(spark):
    got = each(spark, answers.chat_response, [choice(delta={"content": "a"}), choice(delta={"content": "b"}, finish_reason="stop"), choice(delta={}, finish_reason=None), choice(delta={"content": 1}, finish_reason="stop")])
    assert [(r.delta, r.finish, r.fault) for r in got] == [("a", None, None), ("b", "stop", None), (None, None, None), (None, None, "wrong shape")]


def test_embeddings(spark):
    item = lambda v, **at: {"embedding": v, **at}
    cases = [
        ({"data": [item([1, 2.5], index=1), item([3, 4], index=0)]}, ([[3.0, 4.0], [1.0, 2.5]], None)), ({"data": [item([1]), item([2])]}, ([[1.0], [2.0]], None)),
        ({"data": [item([1], index=0), item([2])]}, (None, answers.INDICES)), ({"data": [item([1], index=0), item([2], index=0)]}, (None, answers.INDICES)), ({"data": [item([1], index=0), item([2], index=2)]}, (None, answers.INDICES)),
        ({"data": [item([1], index=0.5), item([2], index=1)]}, (None, answers.INDICES)), ({"data": [item([1], index=None), item([2], index=None)]}, (None, answers.INDICES)), ({"data": [item([1])]}, (None, answers.COUNT)),
        ({"data": []}, (None, answers.EMPTY)), ({"data": "x"}, (None, answers.EMPTY)), ({}, (None, answers.EMPTY)), ([], (None, answers.EMPTY)), (5, (None, answers.WRONG_SHAPE)), ({"data": [item([1]), None]}, (None, answers.WRONG_SHAPE)),
        ({"data": [item([1]), item("x")]}, (None, answers.VECTOR)), ({"data": [item([1]), item(["1"])]}, (None, answers.VECTOR)), ({"data": [item([1]), item([])]}, (None, answers.VECTOR)),
    ]
    got = each(spark, lambda c: answers.embedding_response(c, 2), [json.dumps(c) for c, _ in cases])
    assert [tuple(r) for r in got] == [want for _, want in cases]
    assert tuple(each(spark, lambda c: answers.embedding_response(c, 2), ["{"])[0]) == (None, answers.NOT_JSON)


def test_model_lists(spark):
    assert each(spark, answers.model_names, ['{"models": [{"name": "a"}, {"name": 42}, null, {}]}', '{"models": {}}', "x", "[]"]) == [["a"], None, None, None]


def test_nothing_crashes_on_nulls(spark):
    assert [v.sum() for v in providers.HashedBow().embed([None, "a b"])] == [0, 2]
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, 0.0])], "path string, centroid array<double>")
    assert [(r.left_path, r.right_path) for r in similarity.pairs_above(rows, 0.9).collect()] == [("a", "c")]
    model = providers.Excerpts()
    assert json.loads(model.complete("", "Some Title\nwords and more words"))["quality"] in ("draft", "developed", "polished")


@pytest.mark.parametrize("n", [0, 1])
def test_expected_may_be_a_column(spark, n):
    row = spark.createDataFrame([('{"data": [{"embedding": [1]}]}', n)], "t string, n int").select(answers.embedding_response("t", F.col("n")).alias("r")).first().r
    assert (row.fault is None) == (n == 1)


def test_remembered_words_are_bounded():
    """what a worker remembers doesn't follow its input, and forgetting changes no vector."""
    bow = providers.HashedBow()
    texts = [" ".join(f"w{i}" for i in range(k, k + 30_000)) for k in range(0, 150_000, 30_000)]
    many = bow.embed(texts)
    assert len(bow.buckets) <= 50_000
    assert all((a == providers.HashedBow().embed([t])[0]).all() for a, t in zip(many, texts))


def test_blanks_within_a_text_are_passed_once(spark):
    """F8: the pattern that trimmed tried each of a run of blanks as the last ones, so a long run took the square of its length."""
    within = "{" + " " * 400_000 + "}"
    began = time.monotonic()
    df = spark.createDataFrame([(f"\ufeff \n{within}\u3000 \t",)], "t string")
    assert df.select(T.trim_blank("t"), T.rtrim_blank("t"), T.extracted_json("t")).first() == (within, f"\ufeff \n{within}", within)
    assert time.monotonic() - began < 15


def test_the_forms_of_blank_agree(spark):
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    blank = {c for c in every if re.match(f"[{T.BLANK}]", c)}
    assert blank == set(T.BLANKS) and len(blank) == len(T.BLANKS) == 25
    df = spark.createDataFrame([(c, f"{c}x{c}{c}y{c}") for c in every], "c string, t string")
    found = df.select("c", T.words("t").alias("w"), T.trim_blank("t").alias("t"), T.word_count("t").alias("n")).collect()
    assert [tuple(r) for r in found if r.c in blank] == [(c, ["x", "y"], f"x{c}{c}y", 2) for c in every if c in blank]
    assert all(r.w == [r.t] == [f"{r.c}x{r.c}{r.c}y{r.c}"] for r in found if r.c not in blank)


def test_whether_a_text_is_json_as_a_whole(spark):
    texts = ["{}", "[]", "null", "1", '"a"', ' {"a": [1, {"b": null}]} ', "{} x", "{},1", "1,2", "", "]", "{", '{"a":1}]', '{}, "d41d8cd98f00b204e9800998ecf8427e"', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(answers.is_whole_json("t").alias("a"), answers.whole_json("t").isNotNull().alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [True] * 6 + [False] * 9

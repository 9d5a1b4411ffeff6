"""Responses of model servers, read strictly: a wrong type is told from a missing field.

Texts are parsed to VARIANT. A response has to be one JSON value as a whole, and the
types of what is used are tested, not converted; what a server sent with an error is not passed on,
but for a numeric code. Objects that repeat a key can't be read unless
``spark.sql.variant.allowDuplicateKeys`` is set, which takes the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

NOT_JSON, WRONG_SHAPE, ERROR = "not JSON", "wrong shape", "error"
EMPTY, COUNT, INDICES, VECTOR = "no embeddings", "another number of embeddings", "indices aren't a permutation", "no vector"


def _marked(raw: str | Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(value, whole)`` of a list of the text's value and a mark, and whether the mark was reached.

    The parser stops behind the first value, so the text is put in a list before its
    own digest, which it can't hold itself: that has to come second.
    """

    def listed(text: Column, mark: Column) -> Column:
        return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), lambda v: use(v, F.try_variant_get(v, "$[1]", "string") == mark))

    return let(col(raw), lambda text: let(F.md5(text.cast("binary")), lambda mark: listed(text, mark)))


def whole_json(raw: str | Column) -> Column:
    """A text as VARIANT; null unless all of it is one JSON value."""
    return _marked(raw, lambda v, whole: F.when(whole, F.try_variant_get(v, "$[0]", "variant")))


def is_whole_json(raw: str | Column) -> Column:
    """Whether all of a text is one JSON value, without copying the value."""
    return _marked(raw, lambda v, whole: F.coalesce(whole, F.lit(False)))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN or VOID; null where nothing is."""
    name = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
    return F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(name)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _unlike(value: Column, wanted: str) -> Column:
    """Whether something is there, and of another kind."""
    return F.coalesce(kind(value) != wanted, F.lit(False))


def _isnt(value: Column, wanted: str) -> Column:
    return F.coalesce(kind(value) != wanted, F.lit(True))


def chat_response(raw: str | Column) -> Column:
    """struct(content, delta, finish, code, fault) of a chat response or a piece of a streamed one.

    fault: null if the response has the agreed shape. ``content`` is the first choice's
    message, also an empty one; without it ``answer_fault`` says why there is no answer.
    """
    text = lambda value: F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))

    def bad_choice(c: Column) -> Column:
        message, delta = field(c, "message"), field(c, "delta")
        return (
            _isnt(c, "OBJECT") | _unlike(message, "OBJECT") | (message.isNotNull() & _isnt(field(message, "content"), "STRING"))
            | _unlike(delta, "OBJECT") | _unlike(field(delta, "content"), "STRING")
        )

    def read(v: Column) -> Column:
        error, choices = field(v, "error"), field(v, "choices")
        rows = F.try_variant_get(choices, "$", "array<variant>")
        wrong = _isnt(v, "OBJECT") | _unlike(error, "OBJECT") | _unlike(choices, "ARRAY") | F.coalesce(F.exists(rows, bad_choice), F.lit(False))
        first = F.get(rows, F.lit(0))
        code = F.when(kind(field(error, "code")) == "NUMBER", F.try_variant_get(error, "$.code", "double"))
        fault = F.when(v.isNull(), NOT_JSON).when(wrong, WRONG_SHAPE)
        good = lambda c: F.when(fault.isNull(), c)
        return F.struct(
            good(text(field(field(first, "message"), "content"))).alias("content"), good(text(field(field(first, "delta"), "content"))).alias("delta"),
            good(text(field(first, "finish_reason"))).alias("finish"), good(error.isNotNull()).alias("failed"), good(code).alias("code"), fault.alias("fault"),
        )

    return let(whole_json(raw), read)


def answer(raw: str | Column) -> Column:
    """struct(content, code, fault) of a whole chat response: either content, or a fault (an error's with its code, if it is a number)."""

    def read(r: Column) -> Column:
        fault = F.coalesce(r["fault"], F.when(r["failed"], ERROR), F.when(r["content"].isNull(), WRONG_SHAPE))
        return F.struct(F.when(fault.isNull(), r["content"]).alias("content"), r["code"].alias("code"), fault.alias("fault"))

    return let(chat_response(raw), read)


def embedding_response(raw: str | Column, expected: int | Column) -> Column:
    """struct(vectors, fault) of an embedding response to ``expected`` texts; vectors in the texts' order.

    Items may carry an index each, which have to be a permutation; if none has one, they come in order.
    """
    n = F.lit(expected) if isinstance(expected, int) else expected

    def read(v: Column) -> Column:
        data = field(v, "data")
        items = F.when(kind(data) == "ARRAY", F.try_variant_get(data, "$", "array<variant>"))
        index = lambda item: F.when(kind(field(item, "index")) == "NUMBER", F.try_variant_get(item, "$.index", "double"))
        vector = lambda item: F.when(kind(field(item, "embedding")) == "ARRAY", F.try_variant_get(item, "$.embedding", "array<variant>"))
        numbered = F.exists(items, lambda x: field(x, "index").isNotNull())
        # places n, n + 1, ... are none: a wrong index sorts there and leaves a gap
        places = F.array_sort(F.transform(items, lambda x: F.coalesce(index(x), F.lit(-1.0))))
        permuted = places == F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: i.cast("double"))
        ordered = F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct(F.when(numbered, index(x)).otherwise(i.cast("double")).alias("at"), i.alias("i")))), lambda s: vector(F.get(items, s["i"])))
        numbers = F.transform(ordered, lambda xs: F.transform(xs, lambda x: F.when(kind(x) == "NUMBER", F.try_variant_get(x, "$", "double"))))
        fault = (
            F.when(v.isNull(), NOT_JSON).when(~kind(v).isin("OBJECT", "ARRAY"), WRONG_SHAPE).when(items.isNull() | (F.size(items) == 0), EMPTY).when(F.size(items) != n, COUNT)
            .when(F.exists(items, lambda x: ~F.coalesce(kind(x).isin("OBJECT", "ARRAY"), F.lit(False))), WRONG_SHAPE).when(numbered & ~permuted, INDICES)
            .when(F.exists(numbers, lambda xs: xs.isNull() | (F.size(xs) == 0) | F.exists(xs, lambda x: x.isNull())), VECTOR)
        )
        return F.struct(F.when(fault.isNull(), numbers).alias("vectors"), fault.alias("fault"))

    return let(whole_json(raw), read)


def plain_embeddings(raw: str | Column, expected: int | Column) -> Column:
    """struct(vectors, fault) of a local server's response, a list of vectors in the texts' order."""
    n = F.lit(expected) if isinstance(expected, int) else expected

    def read(v: Column) -> Column:
        rows = F.when(kind(field(v, "embeddings")) == "ARRAY", F.try_variant_get(v, "$.embeddings", "array<variant>"))
        items = F.transform(rows, lambda x: F.when(kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")))
        numbers = F.transform(items, lambda xs: F.transform(xs, lambda x: F.when(kind(x) == "NUMBER", F.try_variant_get(x, "$", "double"))))
        fault = (
            F.when(v.isNull(), NOT_JSON).when(_isnt(v, "OBJECT"), WRONG_SHAPE).when(numbers.isNull() | (F.size(numbers) == 0), EMPTY).when(F.size(numbers) != n, COUNT)
            .when(F.exists(numbers, lambda xs: xs.isNull() | (F.size(xs) == 0) | F.exists(xs, lambda x: x.isNull())), VECTOR)
        )
        return F.struct(F.when(fault.isNull(), numbers).alias("vectors"), fault.alias("fault"))

    return let(whole_json(raw), read)


def model_names(raw: str | Column) -> Column:
    """Names in a list of local models; what has no text for a name is left out. Null unless there is a list."""

    def read(v: Column) -> Column:
        models = F.when(kind(field(v, "models")) == "ARRAY", F.try_variant_get(v, "$.models", "array<variant>"))
        names = F.transform(models, lambda m: F.when(kind(field(m, "name")) == "STRING", F.try_variant_get(m, "$.name", "string")))
        return F.filter(names, lambda n: n.isNotNull())

    return let(whole_json(raw), read)

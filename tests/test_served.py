"""Requests as rows, with a server that is a function."""

import json

import pytest
from loamdex import errors
from loamdex.functions import served


def server_of(fails=()):
    """A local function, so that it travels to the workers whole."""

    def post(url, headers, body, seconds):
        asked = json.loads(body) if body else {}
        if url.endswith("/api/tags"):
            return 200, '{"models": [{"name": "a"}, {"name": 4}, {"name": "b"}]}'
        if "chat" in url:
            text = asked["messages"][1]["content"]
            if text == "secret":
                return 401, "the key sk-1 is wrong"
            if text == "busy":
                return 503, "later"
            if text == "odd":
                return 200, '{"choices": [{"message": {"content": 5}}]}'
            if text == "limit":
                return 200, '{"error": {"code": 429, "message": "sk-1"}}'
            if text == "dead":
                raise OSError("no route")
            return 200, json.dumps({"choices": [{"message": {"content": f"{headers.get('Authorization')} {text}"}}]})
        if "bad" in asked["input"]:
            return 200, "{}"
        vectors = [[float(len(t)), 1.0] for t in asked["input"]]
        if url.endswith("/api/embed"):
            return 200, json.dumps({"embeddings": vectors})
        return 200, json.dumps({"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]})

    return post


def test_answers_fail_alone(spark):
    rows = spark.createDataFrame([(t,) for t in ("hi", "secret", "busy", "odd", "limit", "dead")], "t string")
    where = served.Server("openai-compatible", "http://x/v1", "m", "k")
    got = {r.t: (r.answer, r.error) for r in served.answered(rows, where, "s", "t", server_of(), retries=1, wait=0.0).collect()}
    assert got == {"hi": ("Bearer k hi", None), "secret": (None, "HTTP 401"), "busy": (None, "HTTP 503"), "odd": (None, "wrong shape"), "limit": (None, "error 429"), "dead": (None, "the provider failed")}


@pytest.mark.parametrize("provider", ["openai-compatible", "ollama"])
def test_texts_are_embedded_in_batches(spark, provider):
    rows = spark.createDataFrame([(i, "x" * i if i != 30 else "bad") for i in range(70)] + [(70, None)], "k int, t string").repartition(2)
    where = served.Server(provider, "http://x/v1" if provider != "ollama" else "http://x", "m")
    got = {r.k: (r.vector and list(r.vector), r.error) for r in served.embedded(rows, where, "k", "t", server_of(), batch=4).collect()}
    lost = [k for k, (v, e) in got.items() if v is None]
    assert len(got) == 71 and 30 in lost and len(lost) <= 4 and all(got[k][1] == "no embeddings" for k in lost)
    assert all(v == [float(k if k < 70 else 0), 1.0] and e is None for k, (v, e) in got.items() if k not in lost)


def test_health(spark):
    post = server_of()
    assert served.health(spark, served.Server("ollama", "http://x/v1", "m"), post)["models"] == ["a", "b"]
    assert served.health(spark, served.Server("openai-compatible", "http://x/v1", "m"), post) == {"provider": "openai-compatible", "model": "m", "models": None}
    assert served.embedding_health(spark, served.Server("openai-compatible", "http://x/v1", "m"), post)["dimensions"] == 2
    with pytest.raises(errors.ProviderError, match="HTTP 500"):
        served.health(spark, served.Server("openai-compatible", "http://x/v1", "m"), lambda *a: (500, "secret"))
    for bad in (("openrouter", "http://x", "m"), ("other", "http://x", "m"), ("ollama", "x", "m"), ("ollama", "http://x?y", "m"), ("ollama", "http://x", " ")):
        with pytest.raises(errors.ValidationError):
            served.Server(*bad)

"""Models behind servers: requests as rows.

Bodies are built and responses read as columns (``providers.request_bodies``, ``answers``); a task
only carries bodies to the server and texts back, by ``post(url, headers, body, seconds)``, which
gives (status, text). ``over_http`` is one; tests and closed networks give their own. What a server
says with a failure isn't passed on, only its status.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ProviderError, ValidationError
from ..operators.shared import checkpointed
from . import answers
from .providers import BATCH, endpoint, request_bodies, request_headers, with_retry
from .text import col

Post = Callable[[str, dict[str, str], str, float], tuple[int, str]]
#: Seconds that a request, and a check of a server, may take.
SECONDS, CHECK_SECONDS = 30.0, 10.0
PROVIDERS = ("openai-compatible", "openrouter", "ollama")


def over_http(url: str, headers: dict[str, str], body: str, seconds: float) -> tuple[int, str]:
    """POST a body, or GET without one."""
    asked = urllib.request.Request(url, body.encode() if body else None, headers)
    try:
        with urllib.request.urlopen(asked, timeout=seconds) as found:
            return found.status, found.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


@dataclass(frozen=True)
class Server:
    """Where a provider's models are. A router needs a key."""

    provider: str
    base_url: str
    model: str
    api_key: str = ""

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS or not self.model.strip():
            raise ValidationError("a server needs a known provider and a model")
        if self.provider == "openrouter" and not self.api_key.strip():
            raise ValidationError("this provider needs a key")
        endpoint(self.base_url, "")

    def url(self, suffix: str) -> str:
        return endpoint(self.base_url, suffix)

    @property
    def headers(self) -> dict[str, str]:
        return request_headers(self.provider, self.api_key)


def sent(rows: DataFrame, url: str, headers: dict[str, str], body: str | Column, post: Post = over_http, retries: int = 2, seconds: float = SECONDS, wait: float = 1.0) -> DataFrame:
    """rows with ``response`` and ``refused``: the text of a good answer, or why there is none. Each row is one request and fails alone; what no retry can mend isn't tried again."""

    @F.pandas_udf("response string, refused string")
    def carried(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def once(text: str) -> tuple[str | None, str | None]:
            status, said = post(url, headers, text, seconds)
            if status in (408, 429) or status >= 500:
                raise ProviderError(f"HTTP {status}")
            return (said, None) if 200 <= status < 300 else (None, f"HTTP {status}")

        for part in parts:
            out = []
            for text in part:
                try:
                    out.append(with_retry(lambda text=text: once(text), retries, wait))
                except ProviderError as e:
                    out.append((None, str(e.__cause__) if isinstance(e.__cause__, ProviderError) else str(e)))
            yield pd.DataFrame(out, columns=["response", "refused"])

    return rows.withColumn("_sent", carried(col(body))).withColumns({"response": F.col("_sent.response"), "refused": F.col("_sent.refused")}).drop("_sent")


def answered(rows: DataFrame, server: Server, system: str | Column, user: str | Column, post: Post = over_http, **options) -> DataFrame:
    """rows with ``answer`` and ``error`` of a chat model; options: those of ``sent`` and ``request_bodies``."""
    how = {k: options.pop(k) for k in ("retries", "seconds", "wait") if k in options}
    told = F.lit(system) if isinstance(system, str) else system
    asked = sent(rows, server.url("chat/completions"), server.headers, request_bodies(server.provider, server.model, told, user, **options), post, **how)
    read = asked.withColumn("_a", answers.answer("response"))
    error = F.coalesce("refused", F.when(F.col("_a.fault") == answers.ERROR, F.concat_ws(" ", F.lit("error"), F.col("_a.code").cast("long").cast("string"))), F.col("_a.fault"))
    return read.withColumns({"answer": F.col("_a.content"), "error": error}).drop("_a", "response", "refused")


def embedded(rows: DataFrame, server: Server, key: str, text: str, post: Post = over_http, batch: int = BATCH, **how) -> DataFrame:
    """(key, vector, error): texts embedded, at most ``batch`` in a request. A request that fails leaves its texts without vectors, and says why."""
    # numbered once, so that a rerun asks for the same texts together
    numbered = checkpointed(rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("i")))
    texts = F.array_sort(F.collect_list(F.struct("i", "key", F.coalesce("text", F.lit("")).alias("text"))))
    groups = numbered.groupBy(F.shiftright("i", 33).alias("part"), F.floor(F.col("i") % F.lit(1 << 33) / batch).alias("n")).agg(texts.alias("texts"))
    if server.provider == "ollama":
        url, data = server.url("api/embed"), F.struct(F.lit(server.model).alias("model"), F.transform("texts", lambda x: x["text"]).alias("input"))
        read = answers.plain_embeddings
    else:
        url, data = server.url("embeddings"), F.struct(F.lit(server.model).alias("model"), F.transform("texts", lambda x: x["text"]).alias("input"), F.lit("float").alias("encoding_format"))
        read = answers.embedding_response
    found = sent(groups, url, server.headers, F.to_json(data), post, **how).withColumn("r", read("response", F.size("texts")))
    each = found.select(F.posexplode("texts").alias("at", "x"), "r", "refused")
    return each.select(F.col("x.key").alias(key), F.get("r.vectors", F.col("at")).cast("array<float>").alias("vector"), F.coalesce("refused", "r.fault").alias("error"))


def health(spark: SparkSession, server: Server, post: Post = over_http) -> dict:
    """The least request a server can answer, from the driver: {provider, model, models (of a local server, else None)}; raises if it can't."""
    local = server.provider == "ollama"
    if local:
        base = server.base_url.strip().rstrip("/").removesuffix("/v1")
        status, said = post(f"{base}/api/tags", {}, "", CHECK_SECONDS / 2)
    else:
        one = spark.range(1).select(request_bodies(server.provider, server.model, F.lit(""), F.lit("Hi"), max_tokens=1).alias("body")).first().body
        status, said = post(server.url("chat/completions"), server.headers, one, CHECK_SECONDS)
    if not 200 <= status < 300:
        raise ProviderError(f"HTTP {status}")
    names = spark.createDataFrame([(said,)], "t string").select(answers.model_names("t").alias("n")).first().n if local else None
    if local and names is None:
        raise ProviderError("the list of models can't be read")
    return {"provider": server.provider, "model": server.model, "models": names}


def embedding_health(spark: SparkSession, server: Server, post: Post = over_http) -> dict:
    """{provider, model, dimensions} from one embedding; raises if there is none."""
    row = embedded(spark.createDataFrame([(0, "dimensions")], "k int, t string"), server, "k", "t", post, retries=0).first()
    if row.error is not None:
        raise ProviderError(row.error)
    return {"provider": server.provider, "model": server.model, "dimensions": len(row.vector)}

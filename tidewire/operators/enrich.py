"""Enrichment of pending articles by a language model behind a client."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.plans.session import ship, written

#: A client takes the input text of an article and gives the reply's text; what it raises marks the article failed.
Client = Callable[[str], str]
#: Answers after which another try is no use.
FINAL = (400, 401, 403, 404)
# What a completion is asked with.
MAX_TOKENS, TEMPERATURE = 500, 0.3


def endpoint_of(settings: dict, probe: Callable[[dict], str | None], only: str | None = None) -> tuple[dict, str]:
    """The endpoint of the ``ai`` settings, and its model: the first of ``endpoints`` that can be used, else the
    single one of ``proxy_url`` and ``model``, which isn't asked."""
    if settings.get("endpoints"):
        endpoint, model = select_endpoint(settings["endpoints"], probe, only, settings.get("endpoint_order"))
    elif settings.get("proxy_url"):
        endpoint, model = {"name": "default", "proxy_url": settings["proxy_url"]}, settings.get("model", "")
    else:
        raise ValueError("no endpoint is configured: set proxy_url or endpoints")
    return {**endpoint, "max_tokens": endpoint.get("max_tokens") or settings.get("max_tokens", MAX_TOKENS)}, model


def select_endpoint(endpoints: list[dict], probe: Callable[[dict], str | None], only: str | None = None, order: list[str] | None = None) -> tuple[dict, str]:
    """The first endpoint with a usable model, and that model; by name in ``order``, if given, else as they stand."""
    named = {e["name"]: e for e in endpoints}
    for name in [only] if only is not None else order or list(named):
        if name not in named:
            raise ValueError(f"endpoint not known: {name}")
        if model := probe(named[name]):
            return named[name], model
    raise RuntimeError("no endpoint can be used")


def _address(endpoint: dict) -> str:
    return (endpoint.get("proxy_url") or endpoint["base_url"]).rstrip("/")


def probe(endpoint: dict, timeout: float = 3) -> str | None:
    """The endpoint's model: the configured one, if it lists that, or the first it lists. None if it doesn't
    answer, or its key isn't in the environment."""
    if endpoint.get("api_key_env") and not os.environ.get(endpoint["api_key_env"]):
        return None
    request = urllib.request.Request(_address(endpoint) + "/models", headers=_headers(endpoint))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            listed = [m["id"].removeprefix("models/") for m in json.load(reply).get("data", [])]
    except (OSError, ValueError, KeyError):
        return None
    wanted = endpoint.get("model")
    return next(iter(listed), None) if not wanted else wanted if wanted in listed else None


def _headers(endpoint: dict) -> dict[str, str]:
    key = os.environ.get(endpoint.get("api_key_env") or "", "")
    return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})


def with_retries(call: Callable[[], str], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call``, tried again up to ``retries`` times: after 429 when the answer says, or 5 s; else after 1, 2, 4 ... s."""
    last: Exception = RuntimeError("not tried")
    for k in range(retries + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            last = e
            if e.code in FINAL:
                raise
            wait = float((e.headers or {}).get("Retry-After") or 5) if e.code == 429 else 2.0**k
        except OSError as e:
            last, wait = e, 2.0**k
        if k < retries:
            sleep(wait)
    raise last


def chat_client(endpoint: dict, model: str, system: str, timeout: float = 60, retries: int = 3) -> Client:
    """A client of a chat completion endpoint."""

    def ask(text: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "max_tokens": endpoint.get("max_tokens") or MAX_TOKENS, "temperature": TEMPERATURE}).encode()

        def call() -> str:
            request = urllib.request.Request(_address(endpoint) + "/chat/completions", body, _headers(endpoint))
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]

        return with_retries(call, retries)

    return ask


def _asked(client: Client, interval: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        replies, errors, hashes = [], [], []
        for text in batch.column("input").to_pylist():
            if not first and interval:
                time.sleep(interval)
            first = False
            hashes.append(hashlib.sha256(text.encode()).hexdigest())
            try:
                replies.append(client(text))
                errors.append(None)
            except Exception as e:  # whatever one article raises is that article's failure
                replies.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hashes, pa.string()), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["id", "input_hash", "reply", "error"])


def answers(articles: DataFrame, client: Client, most: int = 8000, interval: float = 0.0, connections: int | None = None) -> DataFrame:
    """id, input_hash, made (title_ja, summary_ja, keywords) and error of each article. ``connections`` ask at a
    time, by default as many as the session has cores; ``interval`` is each one's. Replies are written, so that
    a model is asked once, whatever is done with them."""
    spark = ship(articles.sparkSession)
    asked = articles.select("id", X.model_input(F.col("title"), F.col("summary"), F.col("content"), most).alias("input")).repartition(connections or spark.sparkContext.defaultParallelism)
    replies = asked.mapInArrow(partial(_asked, client, interval), "id long, input_hash string, reply string, error string")
    replies = written(replies, "replies")
    made = X.parse_reply(F.col("reply"))
    return replies.withColumn("made", made).withColumn("error", F.when(F.col("made").isNull(), F.coalesce("error", F.lit("reply not understood")))).drop("reply")


def saved(articles: DataFrame, answered: DataFrame, model: str, prompt_version: str = "1", at: datetime | None = None) -> DataFrame:
    """``articles`` with the answers: completed with texts and merged tags, or failed with the error."""
    now = F.lit(at or datetime.now()).cast("timestamp_ntz")
    joined = articles.join(answered.select("id", "made", "error", "input_hash", F.lit(True).alias("_asked")), "id", "left")
    good, bad = F.col("made").isNotNull(), F.col("_asked") & F.col("made").isNull()
    when = lambda value, c: F.when(good, value).otherwise(F.col(c))
    return joined.withColumns(
        {
            "title_ja": when(F.col("made.title_ja"), "title_ja"),
            "summary_ja": when(F.col("made.summary_ja"), "summary_ja"),
            "tags": when(X.merge_tags(F.col("tags"), F.col("made.keywords")), "tags"),
            "ai_model": when(F.lit(model), "ai_model"),
            "ai_prompt_version": when(F.lit(prompt_version), "ai_prompt_version"),
            "ai_input_hash": when(F.col("input_hash"), "ai_input_hash"),
            "ai_processed_at": when(now, "ai_processed_at"),
            "ai_error": F.when(good, F.lit(None).cast("string")).when(bad, X.failure(F.col("error"))).otherwise(F.col("ai_error")),
            "ai_status": F.when(good, F.lit("completed")).when(bad, F.lit("failed")).otherwise(F.col("ai_status")),
        }
    ).drop("made", "error", "input_hash", "_asked")


def stale(model: str, prompt_version: str, most: int = 8000):
    """Completed articles whose input, model or prompt has changed since."""
    now = F.sha2(X.model_input(F.col("title"), F.col("summary"), F.col("content"), most), 256)
    return (F.col("ai_status") == "completed") & ((F.col("ai_input_hash") != now) | (F.col("ai_model") != model) | (F.col("ai_prompt_version") != prompt_version))


def totals(answered: DataFrame) -> DataFrame:
    return answered.agg(F.count_if(F.col("made").isNotNull()).alias("success"), F.count_if(F.col("made").isNull()).alias("failed"), F.lit(0).cast("long").alias("skipped"), F.count("*").alias("total"))

"""Vectors and answers: a deterministic offline vectorizer, model services, and a hook for others."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simweave.operators.units import within_context

#: The service's usual address, and requests that a task has open at once.
LOCAL = "http://localhost:11434"
REQUESTS = 20
TIMEOUT = 120
EMBEDDING_MODEL, CHAT_MODEL = "nomic-embed-text", "llama3.2"


def hashed_terms(code: Column, dims: int = 256) -> Column:
    """Counts of lower-cased words by hash, as an array of ``dims`` floats."""
    words = F.filter(F.split(F.lower(code), r"[^a-z0-9_]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.crc32(w), F.lit(dims)).cast("int"))
    # each distinct slot is counted once, then read off by position
    distinct = F.array_distinct(slots)
    counts = F.map_from_arrays(distinct, F.transform(distinct, lambda d: F.size(F.filter(slots, lambda s: s == d))))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0)).cast("float"))


def _post(url: str, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.loads(answer.read())


def service_vectors(base: str, model: str = EMBEDDING_MODEL) -> Callable[[Column], Column]:
    """Vectors from a service at ``base``; a failed call fails the task, which is tried again."""

    def one(text: str | None) -> list[float] | None:
        return None if text is None else _post(f"{base}/api/embed", {"model": model, "input": text})["embeddings"][0]

    @F.arrow_udf("array<float>")
    def vectors(code: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(REQUESTS) as pool:
            return pa.array(list(pool.map(one, code.to_pylist())), pa.list_(pa.float32()))

    return vectors


def service_answers(base: str, model: str = CHAT_MODEL) -> Callable[[Column], Column]:
    """Answers of a chat service at ``base``, temperature 0, 32 tokens at most; a failed call is null."""

    def one(prompt: str | None) -> str | None:
        try:
            found = _post(f"{base}/api/chat", {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False, "options": {"temperature": 0, "num_predict": 32}})
            return ((found.get("message") or {}).get("content") or "").strip()
        except (OSError, ValueError):
            return None

    @F.arrow_udf("string")
    def answers(prompt: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(REQUESTS) as pool:
            return pa.array(list(pool.map(one, prompt.to_pylist())), pa.string())

    return answers


#: Vectorizers by name of the embedding source.
VECTORIZERS: dict[str, Callable[[Column], Column]] = {"hashed": hashed_terms}


def service(source: str) -> str | None:
    """The address of the model service that a source names, None if it names none."""
    if source.lower() == "ollama":
        return LOCAL
    return source.rstrip("/") if source.lower().startswith(("http://", "https://")) else None


def vectorizer(source: str) -> Callable[[Column], Column]:
    """The function for a source: a registered name, or the address of a service, which must answer now rather than fail in every task."""
    if not source:
        raise ValueError("no embedding source is set")
    if source in VECTORIZERS:
        return VECTORIZERS[source]
    base = service(source)
    if base is None:
        raise ValueError(f"unknown embedding source {source!r}: name a service's address, or register a function of a column in VECTORIZERS")
    try:
        urllib.request.urlopen(base, timeout=5).close()
    except urllib.error.HTTPError:
        pass  # it is there
    except (OSError, ValueError) as e:
        raise ValueError(f"no service answers at {base}: {e}") from e
    return service_vectors(base)


def answerer(source: str) -> Callable[[Column], Column] | None:
    """The chat function for a source, by its host only; None for a source that is no service."""
    base = service(source or "")
    if base is None:
        return None
    parts = urlsplit(base)
    return service_answers(f"{parts.scheme}://{parts.netloc}")


def embed(units: DataFrame, source: str, context: int) -> DataFrame:
    """``units`` with vectors; code beyond the context has none."""
    return units.withColumn("embedding", within_context(F.col("code"), vectorizer(source)(F.col("code")), context))

"""External models as injectable functions, with deterministic offline defaults.

A model is made by a factory once per task and called with a batch; failures are caught per row,
retried inside the function (never by repeating a Spark task, which would pay for the
whole partition again) and end up in an error column while the batch goes on.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str], is_query: bool) -> np.ndarray: ...


class Reranker(Protocol):
    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


class TextGenerator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class PdfParser(Protocol):
    def pages(self, data: bytes) -> list[str]: ...

    def tables(self, data: bytes) -> list[tuple[int, list[list[str]]]]: ...


def hashing_embedder(dim: int = 64) -> Embedder:
    """Words hashed into a unit vector: texts that share words are near."""

    def embed(texts: list[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1 if h >> 63 else -1
            out[k] /= np.linalg.norm(out[k]) or 1
        return out

    return embed


def overlap_reranker() -> Reranker:
    """The share of a query's distinct words that the text holds."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts):
            a, b = set((q or "").lower().split()), set((t or "").lower().split())
            out.append(len(a & b) / len(a) if a else 0.0)
        return out

    return score


def echo_generator() -> TextGenerator:
    """The last line of the prompt: deterministic, needs nothing."""
    return lambda prompt: (prompt or "").rstrip().rpartition("\n")[2]


def messages_service(url: str, key: str, model: str, max_tokens: int = 1024, timeout: float = 60, opener: Callable | None = None) -> TextGenerator:
    """A generator behind a web service that takes messages and returns parts of text; greedy, no retries of its own."""

    def call(prompt: str) -> str:
        body = {"model": model, "max_tokens": max_tokens, "temperature": 0, "thinking": {"type": "disabled"}, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", "x-api-key": key}, method="POST")
        with (opener or urllib.request.urlopen)(request, timeout=timeout) as reply:
            parts = json.load(reply).get("content") or []
        return "".join(p.get("text", "") for p in parts if isinstance(p, dict))

    if not url:
        raise ValueError("the service has no address")
    return call


def bounded(generator: TextGenerator, limit: int, encode: Callable[[str], list], decode: Callable[[list], str], marker: str = "\n…\n") -> TextGenerator:
    """A generator that sees over-long prompts as their first and last tokens: the question stands at the end."""

    def call(prompt: str) -> str:
        ids = encode(prompt)
        half = limit // 2
        return generator(prompt if len(ids) <= limit else decode(ids[:half]) + marker + decode(ids[-half:]))

    return call


def with_retry(call: Callable, tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` repeated after wait, 2 wait, ... seconds; the last failure is raised."""

    def run(*args):
        for t in range(tries):
            try:
                return call(*args)
            except Exception:
                if t == tries - 1:
                    raise
                sleep(wait * (t + 1))

    return run


def embedded(df: DataFrame, text: str, factory: Callable[[], Embedder] = hashing_embedder, is_query: bool = False, batch: int = 32, out: str = "embedding") -> DataFrame:
    """``df`` with the vector of its text column; a null text has the empty text's."""
    kept = df.columns
    schema = df.select("*", F.array().cast("array<float>").alias(out)).schema
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                b = whole.slice(k, batch)
                vectors = model([x or "" for x in b.column(at).to_pylist()], is_query)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], [*kept, out])

    return df.mapInArrow(run, schema)


def scored(df: DataFrame, query: str, text: str, factory: Callable[[], Reranker] = overlap_reranker, batch: int = 16, out: str = "rerank_score") -> DataFrame:
    """``df`` with the score of each (query, text)."""
    kept = df.columns
    schema = df.select("*", F.lit(0.0).alias(out)).schema
    a, b = kept.index(query), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                s = model(part.column(a).to_pylist(), part.column(b).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([float(x) for x in s], pa.float64())], [*kept, out])

    return df.mapInArrow(run, schema)


def generated(df: DataFrame, prompt: str, factory: Callable[[], TextGenerator] = echo_generator, workers: int | None = None, tries: int = 3, wait: float = 5.0, out: str = "reply", error: str = "error") -> DataFrame:
    """``df`` with ``reply`` and ``error``: a failed row has a null reply and what went wrong.

    ``workers`` bounds how many tasks call the model at once.
    """
    kept = df.columns
    schema = df.select("*", F.lit(None).cast("string").alias(out), F.lit(None).cast("string").alias(error)).schema
    at = kept.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = with_retry(factory(), tries, wait)
        for whole in batches:
            replies, errors = [], []
            for p in whole.column(at).to_pylist():
                try:
                    replies.append(call(p))
                    errors.append(None)
                except Exception as e:  # the row carries it; the batch goes on
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], [*kept, out, error])

    return (df.repartition(workers) if workers else df).mapInArrow(run, schema)

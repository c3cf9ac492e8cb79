"""Model providers behind small interfaces, with deterministic stand-ins, and their distributed calls."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExternalAPIError(RuntimeError):
    """A provider failed; the task fails fast."""


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, prompt: str, system: str | None = None) -> str: ...


class HashEmbedder:
    """Unit vectors from hashed words; equal texts have equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


class CannedCompleter:
    """Replies from a table of prompt parts."""

    def __init__(self, replies: dict[str, str], default: str = "{}"):
        self.replies, self.default = replies, default

    def complete(self, prompt: str, system: str | None = None) -> str:
        return next((v for k, v in self.replies.items() if k in prompt), self.default)


def embed(df: DataFrame, text_col: str, embedder: Embedder, batch: int = 64, most_parallel: int | None = None) -> DataFrame:
    """``embedding`` beside every row; providers are called with ``batch`` texts, by at most ``most_parallel`` tasks."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = s.fillna("").tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in embedder.embed_batch(texts[a : a + batch])], dtype=object)

    if most_parallel:
        df = df.coalesce(most_parallel)
    return df.withColumn("embedding", run(F.col(text_col)))


CALLS = "id string, call_type string, model string, document_name string, chunk_id string, operation string, input_tokens bigint, output_tokens bigint, created_at timestamp, namespace string"


def call_records(rows: DataFrame, call_type: str, model: str, operation: str, sent: str, reply: str | None = None) -> DataFrame:
    """One row of the call log for each row of (namespace, name, chunk_id, sent…); tokens are estimated as characters over 4.

    The id is a hash of the call and of the time of writing, so a retried task logs no second call.
    """
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    now = F.current_timestamp()
    size = lambda c: F.floor(F.length(c) / 4).cast("bigint")
    ident = F.substring(F.md5(F.concat_ws("\x1f", F.lit(operation), now.cast("string"), col("namespace"), col("chunk_id"), col(sent))), 1, 12)
    return rows.select(ident.alias("id"), F.lit(call_type).alias("call_type"), F.lit(model).alias("model"), col("name").alias("document_name"), col("chunk_id").alias("chunk_id"), F.lit(operation).alias("operation"), size(col(sent)).alias("input_tokens"), (size(F.col(reply)) if reply else F.lit(None).cast("bigint")).alias("output_tokens"), now.alias("created_at"), col("namespace").alias("namespace"))


def complete(df: DataFrame, prompt_col: str, completer: Completer, cache: DataFrame | None = None) -> DataFrame:
    """``reply`` beside every row. With a cache (key, reply) only prompts that it lacks are sent, so a retried task repeats no call that was saved."""
    key = F.md5(F.coalesce(F.col(prompt_col), F.lit("")))

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.fillna("").map(completer.complete)

    if cache is None:
        return df.withColumn("reply", run(F.col(prompt_col)))
    d = df.withColumn("key", key)
    known = d.join(cache.select("key", "reply"), "key")
    return known.unionByName(d.join(cache.select("key"), "key", "left_anti").withColumn("reply", run(F.col(prompt_col)))).drop("key")

"""Exact vector search by cosine; JVM-side expressions, one pass, top-k without a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def vector_topk(vectors: DataFrame, probe: list[float], k: int, id_col: str, emb: str = "embedding", threshold: float | None = 0.0) -> DataFrame:
    """The k nearest; hits under the threshold are dropped after the top-k, never before."""
    p = F.array(*[F.lit(float(x)) for x in probe])
    top = vectors.select(id_col, F.round(cosine(F.col(emb), p), 6).alias("score")).orderBy(F.col("score").desc(), id_col).limit(k)
    return top if threshold is None else top.where(F.col("score") >= threshold)

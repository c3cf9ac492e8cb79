"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.storage import materialize

#: Bytes of a written table that is broadcast at most.
BROADCAST_BYTES = 32 << 20


def hinted(written: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its values take at most ``BROADCAST_BYTES``; otherwise a join with it shuffles."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(0)) + 16 for c, t in written.dtypes)
    return F.broadcast(written) if (written.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else written


def _split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key stands once, and the rows of repeated keys. Only keys are shuffled while the list of the repeated ones is small; beyond that the joins are split by AQE where a key is hot."""
    many = hinted(materialize(rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key), "repeated"))
    return rows.join(many, key, "left_anti"), rows.join(many, key, "left_semi")


def once(df: DataFrame, key: str, *payload: str) -> DataFrame:
    """One row per key (the smallest payload); rows with a null key are left out."""
    rows = df.select(F.col(key).alias(key), *[F.col(p) for p in payload]).where(F.col(key).isNotNull())
    one, again = _split(rows, key)
    least = again.groupBy(key).agg(F.min(F.struct(*payload)).alias("p")).select(key, *[F.col(f"p.{p}") for p in payload])
    return one.unionByName(least)


def different(df: DataFrame, key: str, *payload: str) -> DataFrame:
    """Different rows (key, payload…); rows with a null key are left out."""
    one, again = _split(df.select(F.col(key).alias(key), *[F.col(p) for p in payload]).where(F.col(key).isNotNull()), key)
    return one.unionByName(again.distinct())

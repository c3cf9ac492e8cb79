"""Upserts: the last row per key wins, ties broken by all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest in ``order``, nulls lowest. A hash aggregate with map-side combine; no sort, and no window over a hot key."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent are added."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")

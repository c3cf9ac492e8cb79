"""Queries of problem 6: evaluation texts leaking into the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.leaks import find_leaks
from docmill.storage import table


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks, exact and re-parameterised."""
    out = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("item_id").cast("bigint").alias("item_id"), "kind", "n_windows")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).where("kind = 'exact'").select("doc_id", "item_id").distinct()


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
_WIN = """SELECT DISTINCT {id}, array_to_string(w[i:i+12], ' ') AS win
    FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t} WHERE text IS NOT NULL) x, range(1, 100000) r(i)
    WHERE i <= len(w) - 12"""
SQL = {"p6_found": "WITH d AS (" + _WIN.format(id="doc_id", t="documents").replace("range(1, 100000) r(i)", "LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) r") + "), e AS (" + _WIN.format(id="item_id", t="eval_items").replace("range(1, 100000) r(i)", "LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) r") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (win)"}

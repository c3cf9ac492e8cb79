"""Queries of problem 8: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.lookalikes import fit_rewriter, look_alike_pairs, rewrite
from docmill.storage import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    return p.where("a < b").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).distinct()


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    docs = table(spark, sf_dir, "documents")
    return rewrite(docs, "doc_id", "text", fit_rewriter(docs, "text")).select(F.col("id").cast("bigint").alias("doc_id"), "canonical")


QUERIES = {"p8_found": p8_found, "p8_canonical": p8_canonical}
SQL: dict[str, str] = {}

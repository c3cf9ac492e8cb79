"""Queries of problem 3: splitting oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.splitting import split_oversized
from docmill.storage import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the operator had to cut."""
    return split_oversized(table(spark, sf_dir, "chunks"), "chunk_id", "text", "section").where("n_pieces > 1").select(F.col("id").alias("chunk_id")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all chunks."""
    return split_oversized(table(spark, sf_dir, "chunks"), "chunk_id", "text", "section").withColumnRenamed("id", "chunk_id")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {"p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) // 4 > 512"}

"""Queries of problem 2: personal information inside free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import different
from docmill.llm.pii import find_personal_data, fit_model
from docmill.storage import table

FIELDS = (("chunks", "chunk_id", "text"), ("chunks", "chunk_id", "summary"), ("entity_extractions", "extraction_id", "description"))


def _all(spark: SparkSession, sf_dir: str, masked: bool) -> DataFrame:
    out = None
    model = fit_model(table(spark, sf_dir, "chunks"), "chunk_id", "text")
    for t, key, field in FIELDS:
        rows = table(spark, sf_dir, t)
        # repeated rows are left out before their texts are long rows of a result; found kinds are small enough to be told apart afterwards
        one = find_personal_data(different(rows, key, field) if masked else rows, key, field, model, masked).withColumn("field", F.lit(f"{t}.{field}"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, False).select("field", F.col("id").alias("rec_id"), F.explode("kinds").alias("kind")).distinct()


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, readable, with placeholders for the personal data."""
    return _all(spark, sf_dir, True).select("field", F.col("id").alias("rec_id"), "masked")


QUERIES = {"p2_found": p2_found, "p2_masked": p2_masked}
SQL: dict[str, str] = {}

"""Queries of problem 7: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.mixing import mix_sources
from docmill.storage import table

#: The setting that names a public tokenizer's file, and the file where it is unset; never part of the repository.
SETTING, TOKENIZER = "spark.docmill.tokenizer", "/opt/tokenizers/byte_bpe_50k.json"


def _mix(spark: SparkSession, sf_dir: str, total: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), "doc_id", "text", "source", spark.conf.get(SETTING, TOKENIZER), total)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats, shard and place."""
    return _mix(spark, sf_dir)[0].withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each weighted source."""
    return _mix(spark, sf_dir)[1]


def p7_epoch_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p7_mixture, but as large as the weighted sources: small sources are repeated up to their caps and may fall short of their shares."""
    return _mix(spark, sf_dir, "available")[0].withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p7_epoch_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, "available")[1]


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_epoch_mixture": p7_epoch_mixture, "p7_epoch_shares": p7_epoch_shares}
SQL: dict[str, str] = {}

"""Queries of problem 5: missing or wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import different
from docmill.llm.language import LanguageModel, fit_language_model, identify, label_code
from docmill.storage import table


def _model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    return fit_language_model(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    parts = [identify(different(table(spark, sf_dir, t), k, "text"), k, "text", model).withColumn("tbl", F.lit(t)) for t, k in (("chunks", "chunk_id"), ("parsed_documents", "doc_id"))]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    out = []
    for t, k in (("chunks", "chunk_id"), ("parsed_documents", "doc_id")):
        rows = table(spark, sf_dir, t).withColumn("label", label_code(F.col("lang")))
        out.append(_cases(identify(rows, k, "text", model, "label")).withColumn("tbl", F.lit(t)))
    return out[0].unionByName(out[1]).select("tbl", F.col("id").alias("rec_id"), "lang_code").distinct()


def _cases(segments: DataFrame) -> DataFrame:
    """Languages of the records whose label is absent, names another language, or whose text has several."""
    rec = segments.where("lang <> 'und'").groupBy("id").agg(F.collect_set("lang").alias("langs"), F.max(F.when(F.col("is_main"), F.col("lang"))).alias("main"), F.max(F.col("label").isNull()).alias("absent"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    case = F.col("absent") | (F.col("lo") != F.col("main")) | (F.col("hi") != F.col("main")) | (F.size("langs") > 1)
    return rec.where(case).select("id", F.explode("langs").alias("lang_code"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's segments with language and confidence."""
    return _segments(spark, sf_dir).select("tbl", F.col("id").alias("rec_id"), "seg", "start_char", "end_char", "lang", "confidence", "is_main")


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments}
SQL: dict[str, str] = {}

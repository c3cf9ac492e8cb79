"""Queries of problem 4: variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.names import name_entities
from docmill.storage import materialize, table


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ent, rel = table(spark, sf_dir, "entity_extractions"), table(spark, sf_dir, "relation_extractions")
    return materialize(name_entities([(ent, "name", "type"), (rel, "source", None), (rel, "target", None)]), "entities")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    return e.withColumnRenamed("name", "name_a").join(e.withColumnRenamed("name", "name_b"), "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the entity it belongs to."""
    return _entities(spark, sf_dir)


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities}
SQL: dict[str, str] = {}

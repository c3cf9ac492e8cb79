"""Queries of problem 1: near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.components import connected_components
from docmill.llm.near_duplicates import NearDuplicates, near_duplicate_groups, near_duplicate_pairs
from docmill.llm.titles import canonical_udf, same_words_udf
from docmill.storage import materialize, table

#: Similarity of the character trigrams of the words without digits. Two edits change at most 8 of a title's trigrams
#: (one for each letter), so from 24 letters on no title is lost; shorter ones are where the edits change fewer.
TITLE_SIMILARITY = 0.5


def title_pairs(docs: DataFrame, id_col: str = "doc_id", name_col: str = "name") -> DataFrame:
    """(id_a, id_b) of ids whose names are one title up to small edits.

    Candidates come from the near-duplicate operator over character n-grams of
    the words without digits; an exact check of the edits follows, and the
    words with digits must be equal. Titles linked by a chain are one title.
    Null, blank and generic names are in no pair.
    """
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).alias("name")).where("id is not null and name is not null").distinct()
    names = materialize(named.select("id", canonical_udf("name").alias("title")).where("title is not null").distinct(), "titles")
    words = names.select(F.substring_index("title", "|", 1).alias("words")).distinct()
    op = NearDuplicates(words, "words", "words", TITLE_SIMILARITY, 3, "char", sketch_bits=18)
    close = op.pairs().where(same_words_udf("id_a", "id_b")).select("id_a", "id_b")
    titles = names.select("title", F.substring_index("title", "|", 1).alias("words"), F.substring_index("title", "|", -1).alias("digits")).distinct()
    a, b = (titles.select(F.col("words").alias(f"id_{x}"), "digits", F.col("title").alias(x)) for x in "ab")
    group = connected_components(close.join(a, "id_a").join(b, ["id_b", "digits"]), "a", "b").withColumnRenamed("node", "title")
    members = materialize(names.join(group, "title", "left").select("id", F.coalesce("component", "title").alias("g")).distinct(), "members")
    many = members.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    m = members.join(many, "g", "left_semi")
    return m.select("g", F.col("id").alias("id_a")).join(m.select("g", F.col("id").alias("id_b")), "g").where("id_a < id_b").select("id_a", "id_b").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = near_duplicate_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "text", 0.5, 3)
    name = title_pairs(table(spark, sf_dir, "drive_documents"))
    return chunk.select(F.lit("chunk").alias("kind"), "id_a", "id_b").unionByName(name.select(F.lit("name").alias("kind"), "id_a", "id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: class, group, copies and links, at five words and 0.8."""
    return near_duplicate_groups(table(spark, sf_dir, "chunks"), "chunk_id", "text", 0.8, 5)


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL: dict[str, str] = {}

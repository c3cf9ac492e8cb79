"""Token-budgeted context, citations and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import citation_refs
from docmill.operators.fusion import budget_prefix

NOTHING = "No relevant context found."


def json_cost(cols: list[str]) -> Column:
    """Estimated tokens of a flat object: its spaced JSON length over 4 (compact length, and a blank after each comma and colon)."""
    s = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]))
    return F.floor((F.length(s) + 2 * len(cols) - 1) / 4).cast("long")


def block(df: DataFrame, cols: list[str], label: str, budget: int, order: str = "rank") -> DataFrame:
    """One row with a labelled JSON array of the items that fit."""
    fit = budget_prefix(df.withColumn("_cost", json_cost(cols)), "_cost", budget, [], [order])
    item = F.struct(order, F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])).alias("j"))
    arr = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])
    return fit.agg(arr.alias("a")).select(F.when(F.size("a") > 0, F.concat(F.lit(label + "\n["), F.array_join("a", ", "), F.lit("]"))).otherwise(F.lit("")).alias("block"))


def chunk_budget(total: int, kg_chars: int, prompt_chars: int) -> int:
    return max(500, total - kg_chars // 4 - prompt_chars // 4 - 200)


def build_context(entities: DataFrame, relations: DataFrame, chunks: DataFrame, max_entity: int = 4000, max_relation: int = 4000, max_total: int = 16000, prompt_chars: int = 1200) -> str:
    """The three blocks joined by blank lines. The inputs are one query's fused lists, each bounded by its top-k."""
    e = block(entities, ["entity", "type", "description"], "Entities:", max_entity).first()[0]
    r = block(relations, ["source", "target", "description"], "Relationships:", max_relation).first()[0]
    c = block(chunks.withColumn("ref", F.col("rank") + 1), ["ref", "source", "namespace", "text"], "Chunks:", chunk_budget(max_total, len(e) + len(r), prompt_chars)).first()[0]
    return "\n\n".join(x for x in (e, r, c) if x) or NOTHING


def cited_sources(answers: DataFrame, refs: DataFrame, most: int = 10) -> DataFrame:
    """(answer_id, doc_id, namespace, first_ref) of the citations 1 to ``most`` that name a chunk."""
    a = answers.select("answer_id", F.explode(F.array_distinct(citation_refs(F.col("answer")))).alias("ref")).where(F.col("ref").between(1, most))
    return a.join(refs, ["answer_id", "ref"]).groupBy("answer_id", "doc_id", "namespace").agg(F.min("ref").alias("first_ref"))

"""Lookups, listings, navigation and statistics over documents, chunks, the graph and the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import json_list


def by_key(df: DataFrame, **key: str) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    for c, v in key.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def list_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunk_counts(chunks), "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    return by_key(chunks, doc_id=doc_id).orderBy("sequence_index", "chunk_id")


def chunk_detail(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Each chunk with its place among its siblings and its document's name; the totals come from a small aggregate, not from a window over a hot document."""
    total = chunks.groupBy("doc_id").agg(F.count("*").alias("total"))
    out = chunks.join(total, "doc_id").join(docs.select("doc_id", F.col("name").alias("doc_name")), "doc_id", "left")
    return out.select("chunk_id", "doc_id", "sequence_index", "total", (F.col("sequence_index") > 0).alias("has_previous"), (F.col("sequence_index") < F.col("total") - 1).alias("has_next"), F.coalesce(F.size(json_list(F.col("keywords"))), F.lit(0)).alias("n_keywords"), F.coalesce("doc_name", "doc_id").alias("document"))


def chunk_context(chunks: DataFrame, targets: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Neighbours of the target chunks (chunk_id, doc_id, sequence_index) within their documents: an equi-join on document and place, so a hot document costs no more than its neighbours."""
    if not (0 <= before <= 20 and 0 <= after <= 20):
        raise ValueError("before and after must be within 0 and 20")
    t = targets.select(F.col("chunk_id").alias("target"), "doc_id", F.col("sequence_index").alias("at"))
    total = chunks.join(t.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("total"))
    places = t.withColumn("sequence_index", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - before), F.col("at") + after)))
    out = chunks.select("chunk_id", "doc_id", "sequence_index").join(places, ["doc_id", "sequence_index"]).join(total, "doc_id")
    return out.select("target", "chunk_id", "sequence_index", (F.col("chunk_id") == F.col("target")).alias("is_target"), (F.col("at") - before > 0).alias("has_more_before"), (F.col("at") + after < F.col("total") - 1).alias("has_more_after"))


def chunk_rows(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the target chunks (chunk_id, doc_id, …) as a retrieval shows them; totals of their documents by a small aggregate."""
    total = chunks.join(targets.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("total"))
    return targets.join(total, "doc_id").select("chunk_id", "namespace", "text", F.col("doc_id").alias("source"), "sequence_index", (F.col("sequence_index") < F.col("total") - 1).alias("has_next"), "page", "section")


def siblings(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """All chunks of the documents of the target chunks (chunk_id, doc_id)."""
    t = targets.select(F.col("chunk_id").alias("target"), "doc_id")
    return chunks.select("chunk_id", "doc_id", "sequence_index").join(t, "doc_id").select("target", "chunk_id", "sequence_index")


def list_entities(nodes: DataFrame, entity_chunks: DataFrame, entity_type: str | None = None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1 and 500")
    n = nodes if entity_type is None else nodes.where(F.col("entity_type") == entity_type)
    n = n.orderBy("namespace", "entity").limit(limit)
    c = entity_chunks.groupBy("namespace", "entity").agg(F.count("*").alias("chunk_count"))
    return n.join(c, ["namespace", "entity"], "left").select("namespace", "entity", "entity_type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def list_relations(edges: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    """Edges of an entity seen from it, or the first ``limit`` edges."""
    if entity is None:
        return edges.orderBy("namespace", "src", "tgt").limit(limit).select("namespace", F.col("src").alias("source"), F.col("tgt").alias("target"), F.col("keywords").alias("relation"), "weight")
    other = F.when(F.col("src") == entity, F.col("tgt")).otherwise(F.col("src"))
    return edges.where((F.col("src") == entity) | (F.col("tgt") == entity)).select("namespace", F.lit(entity).alias("source"), other.alias("target"), F.col("keywords").alias("relation"), "weight")


def api_calls_page(calls: DataFrame, call_type: str | None = None, namespace: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if call_type is not None:
        calls = calls.where(F.col("call_type") == call_type)
    if namespace is not None:
        calls = calls.where(F.col("namespace") == namespace)
    return calls.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def api_call_stats(calls: DataFrame) -> DataFrame:
    n: Column = F.count("*")
    return calls.agg(n.alias("total"), F.count_if(F.col("call_type") == "llm").alias("llm_calls"), F.count_if(F.col("call_type") == "embedding").alias("embedding_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def namespace_stats(docs: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of each namespace; four partial aggregates are added up in one shuffle."""
    kinds = ("documents", "chunks", "entities", "relations")
    u = None
    for i, d in enumerate((docs, chunks, nodes, edges)):
        one = d.select("namespace", *[F.lit(int(i == j)).cast("long").alias(k) for j, k in enumerate(kinds)])
        u = one if u is None else u.unionByName(one)
    return u.groupBy("namespace").agg(*[F.sum(k).alias(k) for k in kinds])


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("namespaces"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("documents", "chunks", "entities", "relations")])


def oversized(listing: DataFrame, max_size: int, key: str = "doc_id", size: str = "file_size") -> DataFrame:
    """Files above the limit, once per id; a null size passes and is not listed."""
    one = listing.where(F.col(size) > max_size).groupBy(key).agg(F.max(size).alias(size))
    return one.orderBy(F.col(size).desc(), key)


def rank_in(df: DataFrame, part: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)

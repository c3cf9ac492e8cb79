"""Change detection, ingestion decisions, deletion and orphan collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.latest import delete


def detect_changes(listing: DataFrame, index: DataFrame) -> DataFrame:
    """(drive_file_id, change): added, modified, deleted or unchanged. Any difference of the modified time counts, as does a document in error."""
    a = listing.groupBy("drive_file_id").agg(F.max("modified").alias("new_time"))
    b = index.select("drive_file_id", F.col("modified").alias("old_time"), "status", "doc_id")
    j = a.join(b, "drive_file_id", "full_outer")
    legacy = F.col("doc_id") != F.concat(F.lit("gdrive-"), F.col("drive_file_id"))
    change = F.when(F.col("doc_id").isNull(), "added").when(F.col("new_time").isNull(), "deleted").when((F.coalesce("new_time", F.lit("")) != F.coalesce("old_time", F.lit(""))) | legacy | (F.col("status") == "error"), "modified").otherwise("unchanged")
    return j.select("drive_file_id", change.alias("change"))


def ingest_action(new: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """(doc_id, action) of files with content: index, reindex, metadata_only or skip_processing."""
    j = new.join(index.select("doc_id", F.col("content_hash").alias("old_hash"), "status"), "doc_id", "left")
    action = F.when(F.col("status") == "processing", "skip_processing").when(F.col("old_hash").isNull(), "index")
    if not force:
        action = action.when((F.col("old_hash") == F.col("content_hash")) & (F.col("status") != "error"), "metadata_only")
    return j.select("doc_id", action.otherwise("reindex").alias("action"))


def refresh_metadata(old: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Non-empty changed fields of the new rows replace the old ones."""
    j = old.alias("o").join(new.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in cols]), "doc_id", "left")
    pick = [F.when((F.coalesce(F.col(f"new_{c}").cast("string"), F.lit("")) != "") & ~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return j.select("doc_id", *[c for c in old.columns if c not in cols and c != "doc_id"], *pick)


def reset_stuck(docs: DataFrame) -> DataFrame:
    return docs.withColumn("status", F.when(F.col("status") == "processing", "error").otherwise(F.col("status")))


def orphans(mapping: DataFrame, key: list[str], gone: DataFrame) -> DataFrame:
    """Keys all of whose chunks are in ``gone`` (chunk_id)."""
    g = gone.select("chunk_id").distinct()
    hit = mapping.join(g, "chunk_id", "left_semi").select(*key).distinct()
    return hit.join(mapping.join(g, "chunk_id", "left_anti").select(*key).distinct(), key, "left_anti")


def delete_documents(chunks: DataFrame, entity_map: DataFrame, relation_map: DataFrame, doc_ids: DataFrame) -> dict[str, DataFrame]:
    """What is left of chunks and mappings, and the orphaned entities and relations."""
    gone = chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id").distinct()
    return {
        "chunks": delete(chunks, gone, ["chunk_id"]),
        "entity_chunks": delete(entity_map, gone, ["chunk_id"]),
        "relation_chunks": delete(relation_map, gone, ["chunk_id"]),
        "orphan_entities": orphans(entity_map, ["namespace", "entity"], gone),
        "orphan_relations": orphans(relation_map, ["namespace", "src", "tgt"], gone),
    }


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """A reindexed document's chunk set is replaced as a whole; documents of ``new`` that now have no chunks must be passed in ``doc_ids`` of :func:`purge`."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def stale_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of reindexed documents that the new version no longer has."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_semi").join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")


def purge(old: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return old.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")

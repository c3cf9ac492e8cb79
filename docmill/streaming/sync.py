"""Continuous synchronisation: listings arrive as files, each micro-batch is one full listing that is compared with the index."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.maintenance import detect_changes
from docmill.providers import ExternalAPIError
from docmill.storage import materialize

LISTING = "drive_file_id string, modified string, namespace string"


def poll_listings(spark: SparkSession, folder: str, index: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Run ``apply(changes, batch_id)`` for every listing file in order.

    ``index`` is read anew for each batch, so a batch sees what the one before
    wrote; a repeated batch after a failure finds no change and does nothing.
    Without ``seconds`` all waiting listings are taken and the query ends.
    """

    def batch(listing: DataFrame, batch_id: int) -> None:
        if not listing.isEmpty():
            apply(detect_changes(listing.select("drive_file_id", "modified"), index()), batch_id)

    s = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).json(folder)
    w = s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")
    return w.start()


@dataclass
class SyncResult:
    """What a synchronisation did; aborted if a folder could not be listed (then nothing was done) or a provider failed."""

    namespace: str
    added: int = 0
    updated: int = 0
    deleted: int = 0
    aborted: bool = False


_RUNNING: dict[str, threading.Lock] = {}


def sync_namespace(namespace: str, folders: list[str], listing: Callable[[str], DataFrame], index: Callable[[], DataFrame], delete: Callable[[DataFrame], None], ingest: Callable[[DataFrame, bool], None]) -> SyncResult:
    """One synchronisation of a namespace's folders with its index: deletions, then changed files, then new ones.

    A folder that cannot be listed aborts it before anything is deleted, since
    its files would look deleted. ``ingest(changes, force)`` that fails with a
    provider's error ends it; what was done stays. A second call for the same
    namespace waits for the first.
    """
    with _RUNNING.setdefault(namespace, threading.Lock()):
        out, every = SyncResult(namespace), None
        try:
            for f in folders:
                one = materialize(listing(f).select("drive_file_id", "modified"), "listing")
                every = one if every is None else every.unionByName(one)
        except Exception:
            out.aborted = True
            return out
        if every is None:
            return out
        change = materialize(detect_changes(every, index()), "changes")
        n = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
        part = lambda c: change.where(F.col("change") == c)
        if n.get("deleted"):
            delete(part("deleted"))
            out.deleted = n["deleted"]
        try:
            if n.get("modified"):
                ingest(part("modified"), True)
                out.updated = n["modified"]
            if n.get("added"):
                ingest(part("added"), False)
                out.added = n["added"]
        except ExternalAPIError:
            out.aborted = True
        return out


def call_log(calls: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Tokens and calls of each model in windows of event time; rows later than ``late`` are dropped by the watermark."""
    # files without a zone hold UTC
    calls = calls.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", width), "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).select(F.col("window.start").alias("start"), "model", "calls", "input_tokens", "output_tokens")

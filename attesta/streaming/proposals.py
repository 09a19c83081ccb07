"""Proposals as a stream: each micro-batch is merged into the bucketed item table by content id, so replays change nothing.

Also the run log as a stream of the latest run per job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import store
from attesta.operators.runs import latest_per_job
from attesta.sources.buckets import BucketedTable


def items_table(spark: SparkSession, folder: str, buckets: int = 1024) -> BucketedTable:
    """The item table in buckets by range of fingerprint."""
    return BucketedTable(spark, folder, store.SCHEMAS["item"], hex_key=True, buckets=buckets)


def merge_proposals(items: BucketedTable, dismissals: DataFrame, mutes: DataFrame, application: str = "proposals"):
    """foreachBatch function: records a batch of proposals (columns of items) in the buckets it touches, once per batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        items.merge(batch, lambda rows, new: store.record(rows, new, dismissals, mutes), (application, batch_id))
        items.vacuum()

    return run


def start_recording(proposals: DataFrame, items: BucketedTable, dismissals: DataFrame, mutes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Records everything the stream has now, then ends."""
    return (
        proposals.writeStream.foreachBatch(merge_proposals(items, dismissals, mutes)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_runs(log: DataFrame) -> DataFrame:
    """Streaming aggregate: each job's latest run (max_by keeps one row of state per job)."""
    return latest_per_job(log)


def proposals_of(events: DataFrame) -> DataFrame:
    """Event rows as proposals; events of one user and type have one content id, and recording merges them."""
    payload = store.canonical_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    at = F.col("ts").cast("timestamp")
    kind, who = F.lit("tag"), F.col("user_id").cast("string")
    return events.select(
        store.content_id(F.col("event_type"), kind, who, payload, compose=False).alias("fingerprint"), F.col("event_type").alias("folder"), kind.alias("subject_type"),
        who.alias("subject_id"), F.col("event_type").alias("summary"), F.lit(None).cast("double").alias("confidence"), payload.alias("payload"), F.lit("events").alias("producer"),
        F.lit("new").alias("state"), F.lit(None).cast("string").alias("prior_state"), F.lit(None).cast("string").alias("error"), at.alias("created_at"), at.alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )

"""Decisions on proposals: approve, undo and batches, each with an outcome per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import runs, store

IRREVERSIBLE = ("tag-cluster", "tag-unused")


def approve(items: DataFrame, attempts: DataFrame, at: Column) -> DataFrame:
    """Items after write attempts (fingerprint, error, prior_state): applied with its snapshot, or failed with its error."""
    tried = attempts.select("fingerprint", F.col("error").alias("__error"), F.col("prior_state").alias("__prior"), F.lit(True).alias("__hit"))
    rows = items.join(tried, "fingerprint", "left")
    hit, ok = F.col("__hit"), F.col("__error").isNull()
    return rows.withColumns(
        {
            "state": F.when(hit & ok, "applied").when(hit, "failed").otherwise(F.col("state")),
            "prior_state": F.when(hit & ok, F.col("__prior")).otherwise(F.col("prior_state")),
            "error": F.when(hit, F.col("__error")).otherwise(F.col("error")),
            "resolved_at": F.when(hit, at).otherwise(F.col("resolved_at")),
        }
    ).select(*items.columns)


def undo_check(items: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Fingerprints with why they cannot be undone, or null."""
    rows = fingerprints.select("fingerprint").join(items, "fingerprint", "left")
    why = (
        F.when(F.col("state").isNull(), "unknown")
        .when(F.col("state") == "gone", "its subject is gone")
        .when(~F.col("state").isin("applied", "failed"), "not applied")
        .when(F.col("subject_type").isin(*IRREVERSIBLE), "cannot be undone")
        .when(F.col("prior_state").isNull(), "no snapshot")
    )
    return rows.select("fingerprint", why.alias("refused"))


def undo(items: DataFrame, fingerprints: DataFrame, at: Column) -> DataFrame:
    """Items with those that can be undone set to reverted."""
    free = undo_check(items, fingerprints).where("refused is null")
    return store.set_state(items, free, "reverted", at)


def batch_outcomes(items: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One row per asked fingerprint: ready, or the reason why it cannot be applied. A batch never stops at one."""
    rows = fingerprints.select("fingerprint").distinct().join(items, "fingerprint", "left")
    why = F.when(F.col("state").isNull(), "unknown").when(F.col("state").isin(*store.HIDDEN), "not visible").when(F.col("state") == "applied", "already applied")
    return rows.select("fingerprint", "subject_type", F.coalesce(why, F.lit("ready")).alias("outcome"))


def applied_outcomes(ready: DataFrame, written: DataFrame) -> DataFrame:
    """(fingerprint, verdict, reason) after writes: ``written`` has (fingerprint, error)."""
    rows = ready.join(written, "fingerprint", "left")
    verdict = F.when((F.col("outcome") == "ready") & F.col("error").isNull(), "applied").otherwise("failed")
    return rows.select("fingerprint", verdict.alias("verdict"), F.when(F.col("outcome") != "ready", F.col("outcome")).otherwise(F.col("error")).alias("reason"))


def find(items: DataFrame, fingerprint: str) -> DataFrame:
    return store.visible(items).where(F.col("fingerprint") == fingerprint)


def scan_status(log: DataFrame, job: str = "scan") -> DataFrame:
    """One row: state (never, running, or the latest run's outcome), started, finished, counts, error, and whether a scan may start."""
    latest = log.where(F.col("job") == job).agg(F.max_by(F.struct("started", "finished", "outcome", "counts", "error"), F.struct("started", "seq")).alias("r"), F.count_if(F.col("finished").isNull()).alias("open"))
    state = F.when(F.col("open") > 0, "running").when(F.col("r").isNull(), "never").otherwise(F.col("r.outcome"))
    return latest.select(state.alias("state"), "r.started", "r.finished", "r.counts", "r.error", (F.col("open") == 0).alias("may_start"))


def start_scan(log: DataFrame, run: DataFrame, job: str = "scan") -> DataFrame:
    """The log with ``run`` (one row of the run table) begun; a scan that is still running raises."""
    status = scan_status(log, job).select("may_start")
    held = run.crossJoin(F.broadcast(status)).withColumn("id", F.when(F.col("may_start"), F.col("id")).otherwise(F.raise_error(F.lit("a scan is running"))))  # one row
    return runs.start_run(log, held.select(*log.columns))

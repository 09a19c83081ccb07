"""The run log: appends, closing, retention, latest runs and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.vocab import INBOXES

KEEP_RUNS, KEEP_JOBS, RECENT = 500, 200, 20


def record_run(runs: DataFrame, ticks: DataFrame) -> DataFrame:
    """(producer, at) with a tick's producers set to its time."""
    return runs.join(ticks.select("producer"), "producer", "left_anti").unionByName(ticks.select(*runs.columns))


def last_run(runs: DataFrame, producer: str) -> DataFrame:
    return runs.where(F.col("producer") == producer).select("at")


def start_run(log: DataFrame, run: DataFrame) -> DataFrame:
    return log.unionByName(run.select(*log.columns))


def finish_run(log: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with the finish, outcome, counts and error of ``finished`` (id, finished, outcome, counts, error)."""
    done = finished.select("id", *[F.col(c).alias(f"__{c}") for c in ("finished", "outcome", "counts", "error")], F.lit(True).alias("__done"))
    rows = log.join(done, "id", "left")
    return rows.withColumns({c: F.when(F.col("__done"), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("finished", "outcome", "counts", "error")}).select(*log.columns)


def retain(log: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """Open runs and the newest ``keep`` finished ones, by start, then sequence. The cut is a top-k, not a global sort."""
    newest = log.where("finished is not null").orderBy(F.desc("started"), F.desc("seq")).limit(keep)
    return log.where("finished is null").unionByName(newest)


def evicted(log: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """One row: how many finished runs retention drops."""
    return log.agg(F.greatest(F.count_if(F.col("finished").isNotNull()) - keep, F.lit(0)).alias("n"))


def close_interrupted(log: DataFrame, own: Sequence[str], at: Column) -> DataFrame:
    """Open runs that this instance did not start, closed as interrupted."""
    left = F.col("finished").isNull() & (~F.col("id").isin(*own) if own else F.lit(True))
    return log.withColumns({"outcome": F.when(left, "interrupted").otherwise(F.col("outcome")), "finished": F.when(left, at).otherwise(F.col("finished"))})


def recent_runs(log: DataFrame, limit: int = RECENT) -> DataFrame:
    return log.orderBy(F.desc("started"), F.desc("seq")).limit(limit)


def runs_evicted(counter: DataFrame) -> DataFrame:
    return counter.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def latest_per_job(log: DataFrame) -> DataFrame:
    """Each job's latest run, by start, then sequence."""
    rest = [c for c in log.columns if c != "job"]
    return log.groupBy("job").agg(F.max_by(F.struct(*rest), F.struct("started", "seq")).alias("run")).select("job", *[F.col(f"run.{c}") for c in rest])


def inbox_of(subject_type: Column, inboxes: dict[str, tuple[str, ...]] = INBOXES) -> Column:
    """Inbox of a subject type; an unknown type is a heading of its own."""
    pairs = [F.lit(x) for name, types in inboxes.items() for t in types for x in (t, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), subject_type), subject_type)


def waiting_counts(counts: DataFrame, inboxes: dict[str, tuple[str, ...]] = INBOXES) -> DataFrame:
    """(inbox, n) of (subject_type, n), with 0 for headings that have none."""
    spark = counts.sparkSession
    headings = spark.createDataFrame([(h, 0) for h in inboxes], "inbox string, n long")
    rolled = counts.select(inbox_of(F.col("subject_type"), inboxes).alias("inbox"), F.col("n").cast("long").alias("n"))
    return rolled.unionByName(headings).groupBy("inbox").agg(F.sum("n").alias("n"))


def unmapped_types(items: DataFrame, inboxes: dict[str, tuple[str, ...]] = INBOXES) -> DataFrame:
    """Subject types that no inbox shows; must be empty."""
    known = [t for types in inboxes.values() for t in types]
    return items.select("subject_type").distinct().where(~F.col("subject_type").isin(*known))


def recorded_counts(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """One row: proposals that a visible item now holds, and those skipped."""
    seen = items.where(~F.col("state").isin("dismissed", "muted", "superseded", "gone")).select("fingerprint").distinct().withColumn("__seen", F.lit(True))
    return proposals.join(seen, "fingerprint", "left").agg(F.count_if(F.col("__seen")).alias("recorded"), F.count_if(F.col("__seen").isNull()).alias("skipped"))


def store_rank(log: DataFrame) -> DataFrame:
    """Runs with their place within their job, newest first."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("started"), F.desc("seq"))))

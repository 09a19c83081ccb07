"""Narrowing a batch: filter, standing exclusions, then the limit; sweeps against a complete read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.paging import ranked


def pool(unorganized: DataFrame, marked: DataFrame, key: str = "id") -> DataFrame:
    """Both scans, a key of the first not repeated; ``added`` marks rows that only the second has."""
    more = marked.join(unorganized.select(key), key, "left_anti")
    return unorganized.withColumn("added", F.lit(False)).unionByName(more.withColumn("added", F.lit(True)))


def paths_of(files: Column) -> Column:
    """Lower-case paths of an array of files."""
    return F.transform(files, lambda f: F.lower(f["path"]))


def subjects_of(items: DataFrame, subject_type: str) -> DataFrame:
    return items.where(F.col("subject_type") == subject_type).select("subject_id").distinct()


def first_path(files: Column) -> Column:
    """Path of the first file; a row without one raises."""
    path = F.try_element_at(files, F.lit(1))["path"]
    return F.when(path.isNotNull(), path).otherwise(F.raise_error(F.lit("a scene without files has no path")))


def classify(rows: DataFrame, key: str, muted: DataFrame, proposed: DataFrame, keep: Column | None = None) -> DataFrame:
    """``rows`` with reason: filtered_out, muted, already_proposed or selected; the first that holds.

    ``muted`` and ``proposed`` are one-column tables of keys; repeats there do no harm.
    """
    mark = lambda keys, name: keys.select(F.col(keys.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    flagged = rows.join(mark(muted, "__muted"), key, "left").join(mark(proposed, "__proposed"), key, "left")
    out = F.lit(False) if keep is None else ~F.coalesce(keep, F.lit(False))
    reason = F.when(out, "filtered_out").when(F.col("__muted"), "muted").when(F.col("__proposed"), "already_proposed").otherwise("selected")
    return flagged.withColumn("reason", reason).drop("__muted", "__proposed")


def select_batch(rows: DataFrame, key: str, muted: DataFrame, proposed: DataFrame, keep: Column | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """classify, then the limit: selected rows beyond the first ``limit`` in key order become deferred.

    None takes all, 0 none. Two passes find the cut without sorting the table into one task: the key of the last row
    that fits is a top-k, and rows are then compared with it.
    """
    if limit is not None and limit < 0:
        raise ValueError("a limit is not negative")
    judged, order = classify(rows, key, muted, proposed, keep), order or key
    if limit is None:
        return judged
    chosen = F.col("reason") == "selected"
    fits = judged.where(chosen).select(order).orderBy(order).limit(limit)
    last = fits.agg(F.max(order).alias("__last"))
    late = chosen & (F.col("__last").isNull() | (F.col(order) > F.col("__last")))
    return judged.crossJoin(F.broadcast(last)).withColumn("reason", F.when(late, "deferred").otherwise(F.col("reason"))).drop("__last")  # one row


def tally(judged: DataFrame) -> DataFrame:
    """How many rows each reason has."""
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def completeness(read: DataFrame, reported: int | Column, key: str = "id") -> DataFrame:
    """One row: rows, distinct keys, and whether the read is complete (neither empty, repeated nor short)."""
    return read.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct")).withColumn(
        "complete", (F.col("rows") > 0) & (F.col("distinct") == F.col("rows")) & (F.col("rows") == reported)
    )


def gone_sweep(stored: DataFrame, present: DataFrame, reported: int | DataFrame, key: str = "id") -> DataFrame:
    """Stored keys that a complete read no longer has; none if the read is empty, partial or repeats keys.

    ``reported``: how many the source says it has, or a table of one row with it. Keys of both tables are counted in one aggregate, from
    which both the missing ones and the read's completeness follow, so ``present`` is read once, in the same pass.
    """
    both = present.select(F.col(key), F.lit(1).alias("__read"), F.lit(0).alias("__kept")).unionByName(stored.select(F.col(key), F.lit(0).alias("__read"), F.lit(1).alias("__kept")))
    counted = both.groupBy(key).agg(F.sum("__read").alias("__read"), F.max("__kept").alias("__kept"))
    told = stored.sparkSession.range(1).select(F.lit(reported).cast("long").alias("__told")) if isinstance(reported, int) else reported.select(F.col(reported.columns[0]).cast("long").alias("__told"))
    seen = counted.agg(F.sum("__read").alias("__rows"), F.max("__read").alias("__most"))
    check = seen.crossJoin(told).where("__rows > 0 and __most = 1 and __rows = __told").select("__told")  # one row or none
    missing = counted.where("__kept = 1 and __read = 0").select(key)
    return missing.crossJoin(F.broadcast(check)).drop("__told")


def release_mutes(mutes: DataFrame, retired_reason: str) -> DataFrame:
    """Mutes without those of a retired reason."""
    return mutes.where(~F.col("reason").eqNullSafe(F.lit(retired_reason)))


def narrowings(mutes: DataFrame, items: DataFrame, subject_type: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(muted, proposed) subject ids: mutes hold in any folder, proposals in their own."""
    muted = mutes.where(F.col("subject_type") == subject_type).select("subject_id").distinct()
    return muted, subjects_of(items.where((F.col("folder") == folder) & ~F.col("state").isin("dismissed", "muted", "superseded", "gone")), subject_type)


def look_up_once(rows: DataFrame, key: str, lookup) -> DataFrame:
    """Rows with the answer of ``lookup`` (a function of a one-column table of distinct keys), asked once per key."""
    return rows.join(lookup(rows.select(key).distinct()), key, "left")


def chunks(rows: DataFrame, order: str, size: int = 200, within: str | None = None) -> DataFrame:
    """Rows with their chunk number: ``size`` rows each, in order, within each value of ``within``.

    Rows are ranked over ranges of (``within``, ``order``), so neither all rows nor those of a frequent value meet in one task.
    """
    place = ranked(rows, [order] if within is None else [within, order])
    if within is None:
        return place.withColumn("chunk", F.floor(F.col("rank") / size).cast("long")).drop("rank")
    first = place.groupBy(within).agg(F.min("rank").alias("__first"))  # combined in each task
    found = place.join(first, place[within].eqNullSafe(first[within])).drop(first[within])
    return found.withColumn("chunk", F.floor((F.col("rank") - F.col("__first")) / size).cast("long")).select(*rows.columns, "chunk")

"""Choosing among scored candidates, or refusing with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import normalize

# Bar of a match, bar of a single telling word, margin of a tie.
THRESHOLD, GENERIC, MARGIN = 0.7, 0.9, 0.05


def is_eligible(value: Column, contained: Column, meaningful: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(meaningful == 0, False).when(contained, True).when(meaningful < 2, value >= GENERIC).otherwise(value >= threshold)


def shortfall(value: Column, meaningful: Column, threshold: float = THRESHOLD) -> Column:
    """How far a candidate is from being eligible; infinite without evidence."""
    return F.when(meaningful == 0, F.lit(float("inf"))).when(meaningful < 2, F.lit(GENERIC) - value).otherwise(F.lit(threshold) - value)


def decide(candidates: DataFrame, subject: str = "subject", threshold: float = THRESHOLD, normal=normalize) -> DataFrame:
    """One row per subject of (subject, idx, value, contained, meaningful, title) rows.

    outcome: chosen, ambiguous or none; idx, value, title of the choice; of no choice, the candidate that came closest
    (near_idx); contenders: eligible candidates; interrogated: all candidates have evidence. One shuffle by subject.
    """
    rows = candidates.withColumn("eligible", is_eligible(F.col("value"), F.col("contained"), F.col("meaningful"), threshold)).withColumn("normal", normal(F.col("title")))
    best = F.max(F.when(F.col("eligible"), F.col("value"))).over(Window.partitionBy(subject))
    tied = F.col("eligible") & (F.round(best - F.col("value"), 3) <= MARGIN)
    rows = rows.withColumn("tied", F.coalesce(tied, F.lit(False))).withColumn("short", shortfall(F.col("value"), F.col("meaningful"), threshold))
    pick = F.struct("idx", "value", "title")
    on = lambda flag, x: F.when(F.col(flag), x)
    grouped = rows.groupBy(subject).agg(
        F.count_if("eligible").alias("contenders"),
        F.count_if("tied").alias("n_tied"),
        F.count_distinct(on("tied", F.col("normal"))).alias("n_titles"),
        F.every(F.col("meaningful") > 0).alias("interrogated"),
        F.min_by(pick, on("eligible", F.struct(-F.col("value"), F.col("idx")))).alias("top"),
        F.min_by(pick, on("tied", F.struct(F.col("title"), F.col("idx")))).alias("agreed"),
        F.min_by("idx", F.struct(F.col("short"), -F.col("value"), F.col("idx"))).alias("near_idx"),
    )
    outcome = F.when(F.col("contenders") == 0, "none").when((F.col("n_tied") > 1) & (F.col("n_titles") > 1), "ambiguous").otherwise("chosen")
    chosen = F.when(F.col("outcome") == "chosen", F.when(F.col("n_tied") > 1, F.col("agreed")).otherwise(F.col("top")))
    out = grouped.withColumn("outcome", outcome).withColumn("pick", chosen)
    return out.select(
        subject, "outcome", "pick.idx", "pick.value", "pick.title", "contenders", "interrogated", F.when(F.col("outcome") == "none", F.col("near_idx")).alias("near_idx")
    )


def runners_up(candidates: DataFrame, decisions: DataFrame, subject: str = "subject", most: int = 3) -> DataFrame:
    """The best losers of each decided subject, by falling value, then title; each with its own ``url`` if candidates have one."""
    losers = candidates.join(decisions.where("outcome = 'chosen'").select(subject, F.col("idx").alias("won")), subject).where("idx <> won").drop("won")
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("value"), "title", "idx"))
    return losers.withColumn("place", rank).where(F.col("place") <= most).select(subject, "idx", "value", "title", "place", *(["url"] if "url" in candidates.columns else []))


def choose_winner(winners: DataFrame, subject: str = "subject", normal=normalize) -> DataFrame:
    """One row per subject of (subject, store, resolvable, value, title) rows, one winner per store.

    Stores that can confirm owners outrank the others. The best is chosen if all within MARGIN of it share one title
    (else ambiguous); the rest are competing or, with the same title, agreeing stores.
    """
    rows = winners.withColumn("normal", normal(F.col("title")))
    of = Window.partitionBy(subject)
    rows = rows.withColumn("rank_class", F.max(F.col("resolvable").cast("int")).over(of)).where(F.col("resolvable").cast("int") == F.col("rank_class"))
    rows = rows.withColumn("top", F.max("value").over(of)).withColumn("tied", F.round(F.col("top") - F.col("value"), 3) <= MARGIN)
    grouped = rows.groupBy(subject).agg(
        F.count_distinct(F.when(F.col("tied"), F.col("normal"))).alias("n_titles"),
        F.min_by(F.struct("store", "value", "title", "normal"), F.struct(-F.col("value"), F.col("store"))).alias("first"),
        F.collect_list(F.struct("store", "normal")).alias("every"),
    )
    clear = F.col("n_titles") == 1
    others = F.filter("every", lambda x: x["store"] != F.col("first.store"))
    names = lambda same: F.array_sort(F.transform(F.filter(others, lambda x: (x["normal"] == F.col("first.normal")) == same), lambda x: x["store"]))
    return grouped.select(
        subject, F.when(clear, F.col("first.store")).alias("store"), F.when(clear, F.col("first.value")).alias("value"), F.when(clear, F.col("first.title")).alias("title"),
        (~clear).alias("ambiguous"), F.when(clear, names(True)).alias("agreeing"), F.when(clear, names(False)).alias("competing"),
    )


def closest_refusal(refused: DataFrame, subject: str = "subject") -> DataFrame:
    """The store whose best candidate came nearest, ties by name: (subject, store, best)."""
    best = refused.groupBy(subject, "store").agg(F.max("value").alias("best"))
    return best.groupBy(subject).agg(F.min_by("store", F.struct(-F.coalesce("best", F.lit(-1.0)), F.col("store"))).alias("store"), F.max("best").alias("best"))


def store_reports(stores: DataFrame, candidates: DataFrame, subject: str = "subject") -> DataFrame:
    """Per subject and asked store: rows, best value, title, url and error, closest miss first (place)."""
    found = candidates.groupBy(subject, "store").agg(
        F.count(F.lit(1)).alias("rows"), F.max("value").alias("score"), F.max_by(F.struct("title", "url"), F.struct(F.col("value"), -F.col("idx"))).alias("best")
    )
    rows = stores.select(subject, "store", "error").join(found, [subject, "store"], "left")
    place = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc_nulls_last("score"), "store"))
    return rows.select(subject, "store", F.coalesce("rows", F.lit(0)).alias("rows"), "score", "best.title", "best.url", "error", place.alias("place"))

"""What a source's whole listing says about a file: is it absent there?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import linkage
from attesta.operators.decisions import THRESHOLD, decide
from attesta.session import written_once


def listing_completeness(pages: DataFrame, source: str = "source") -> DataFrame:
    """(source, rows, complete) of (source, page, reported, rows) pages: complete if the rows reach the first reported count."""
    return pages.groupBy(source).agg(
        F.sum("rows").alias("rows"), (F.sum("rows") >= F.min_by("reported", "page")).alias("complete"), F.count(F.lit(1)).alias("pages_read")
    )


def listing_verdict(decisions: DataFrame) -> DataFrame:
    """Adds unlisted (true, false or null: not known) and why.

    Reads outcome, contenders, interrogated, rows, complete, certain, performer_id, listing_performer_id. A null
    certainty or another performer's listing raises.
    """
    bad = F.col("certain").isNull() | ~F.col("performer_id").eqNullSafe(F.col("listing_performer_id"))
    why = (
        F.when(bad, F.raise_error(F.lit("certainty must be stated, and the listing be the performer's own")))
        .when(~F.col("certain"), "attribution uncertain")
        .when(F.col("outcome") == "chosen", "present")
        .when(F.col("contenders") > 0, "contenders undecided")
        .when(~F.coalesce("interrogated", F.lit(False)) & (F.col("rows") > 0), "no evidence in the name")
        .when(~F.col("complete"), "listing incomplete")
        .otherwise("unlisted")
    )
    rows = decisions.withColumn("why", why)
    return rows.withColumn("unlisted", F.when(F.col("why") == "unlisted", True).when(F.col("why") == "present", False))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row: checked, unlisted, present, inconclusive."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("unlisted").alias("unlisted"), F.count_if(~F.col("unlisted")).alias("present"), F.count_if(F.col("unlisted").isNull()).alias("inconclusive")
    )


def check_listings(
    files: DataFrame, resolutions: DataFrame, ids: DataFrame, listings: DataFrame, states: DataFrame, pairs: dict[str, list[str]] | None = None, threshold: float = THRESHOLD
) -> dict[str, DataFrame]:
    """A pass over files against one source's listings: ``verdicts`` of the files checked, ``skipped`` ones with why, ``counts`` in one row.

    ``files``: (id, name, folder); ``resolutions``: attribution.resolve; ``ids``: (artist, performer_id); ``listings``: (performer_id,
    idx, title), each read once whatever the number of files; ``states``: (performer_id, rows, complete, error). A file
    without a creator, whose creator has no id there, or whose listing could not be read is skipped: nothing is concluded.
    """
    who = resolutions.select("id", F.col("name").alias("artist"), (F.col("competing").isNull() & F.col("rejected_folder").isNull()).alias("certain"))
    known = files.select("id", "name", "folder").join(who, "id").join(ids.select("artist", "performer_id"), "artist", "left").join(states, "performer_id", "left")
    why = (
        F.when(F.col("artist").isNull(), "no creator resolved")
        .when(F.col("performer_id").isNull(), "no id is known for the creator")
        .when(F.col("error").isNotNull(), F.concat(F.lit("the listing could not be read: "), F.col("error")))
        .when(F.col("rows").isNull(), "the listing was not read")
    )
    judged = written_once(known.withColumn("skipped", why))
    ready = judged.where("skipped is null")
    candidates = listings.join(ids, "performer_id").select("artist", F.lit("listing").alias("store"), F.lit(True).alias("resolvable"), "idx", "title", F.lit(None).cast("string").alias("url"))
    scored = linkage.judge(ready.select("id", "name", "folder", "artist"), candidates, pairs or {})
    # the listing's own titles decide whether two entries name one scene
    told = scored.drop("title").join(candidates.select("artist", "idx", "title").join(ready.select("id", "artist"), "artist").select("id", "idx", "title"), ["id", "idx"])
    made = decide(told, "id", threshold).select("id", "outcome", "idx", "title", "contenders", "interrogated")
    rows = ready.join(made, "id", "left").withColumns({"outcome": F.coalesce("outcome", F.lit("none")), "contenders": F.coalesce("contenders", F.lit(0)), "interrogated": F.coalesce("interrogated", F.lit(False))})
    verdicts = listing_verdict(rows.withColumn("listing_performer_id", F.col("performer_id"))).select("id", "artist", "performer_id", "outcome", "title", "unlisted", "why")
    skipped = judged.where("skipped is not null").select("id", "artist", F.col("skipped").alias("why"))
    counts = verdict_counts(verdicts).crossJoin(skipped.agg(F.count(F.lit(1)).alias("skipped")))  # two single rows
    return {"verdicts": verdicts, "skipped": skipped, "counts": counts}

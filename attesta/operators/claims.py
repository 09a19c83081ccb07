"""Identification by file fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import is_in
from attesta.functions.vocab import EXACT_ALGORITHMS, FINGERPRINT_ALGORITHMS


def is_exact_hit(fingerprints: Column) -> Column:
    """Whether any fingerprint of a match is of an exact algorithm."""
    return F.exists(fingerprints, lambda f: is_in(f["algorithm"], EXACT_ALGORITHMS))


def checked_fingerprints(rows: DataFrame) -> DataFrame:
    """(algorithm, hash) rows in order of first appearance; an unknown algorithm or empty hash raises when read."""
    ok = is_in(F.col("algorithm"), FINGERPRINT_ALGORITHMS) & (F.coalesce("hash", F.lit("")) != "")
    message = F.concat(F.lit("not a fingerprint: "), F.coalesce("algorithm", F.lit("?")))
    return rows.withColumn("hash", F.when(F.coalesce(ok, F.lit(False)), F.col("hash")).otherwise(F.raise_error(message))).dropDuplicates(["algorithm", "hash"])


def known_by_fingerprint(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Hits of each distinct fingerprint, an empty list where the source has none."""
    hits = listing.groupBy("algorithm", "hash").agg(F.array_sort(F.collect_list("site_id")).alias("hits"))
    return checked_fingerprints(rows).join(hits, ["algorithm", "hash"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def resolve_claims(claims: DataFrame, subject: str = "subject") -> DataFrame:
    """One row per subject of (subject, box, ord, site_id, exact) claims that has an exact one.

    outcome: identified if its exact claims all name the same site_id, else conflict. A single exact claim
    identifies whatever it names. agreeing: later boxes of the same answer; perceptual: ids that only similar
    fingerprints name.
    """
    exact = lambda x: F.when(F.col("exact"), x)
    grouped = claims.groupBy(subject).agg(
        F.count_if("exact").alias("n_exact"),
        F.count_distinct(exact(F.col("site_id"))).alias("n_ids"),
        F.bool_or(exact(F.col("site_id").isNull())).alias("unknown"),
        F.min_by(F.struct("box", "site_id"), exact(F.struct(F.col("ord"), F.col("site_id")))).alias("first"),
        F.collect_set(exact(F.col("box"))).alias("boxes"),
        F.collect_set(F.when(~F.col("exact"), F.col("site_id"))).alias("similar"),
    )
    sure = (F.col("n_exact") == 1) | ((F.col("n_ids") == 1) & ~F.col("unknown"))
    rows = grouped.where("n_exact > 0").withColumn("outcome", F.when(sure, "identified").otherwise("conflict"))
    known = F.col("outcome") == "identified"
    return rows.select(
        subject, "outcome", F.when(known, F.col("first.site_id")).alias("site_id"), F.when(known, F.col("first.box")).alias("box"),
        F.when(known, F.array_sort(F.array_remove(F.col("boxes"), F.col("first.box")))).alias("agreeing"),
        F.when(known, F.array_sort(F.filter("similar", lambda x: ~x.eqNullSafe(F.col("first.site_id"))))).alias("perceptual"),
    )


def conflict_detail(claims: DataFrame, subject: str = "subject") -> DataFrame:
    """All exact claims of a subject as one line of text."""
    line = F.struct(F.col("ord"), F.concat_ws(" ", F.col("box"), F.lit("says"), F.coalesce("site_id", F.lit("nothing"))).alias("text"))
    return claims.where("exact").groupBy(subject).agg(F.array_join(F.array_sort(F.collect_list(line))["text"], "; ").alias("detail"))


def identify(subjects: DataFrame, boxes: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolutions, errors). ``boxes``: (box, ord, error); a box with an error is reported and its replies ignored."""
    usable = boxes.where("error is null").select("box", "ord")
    claims = lookups.join(usable, "box").join(subjects.select("subject"), "subject", "left_semi")
    return resolve_claims(claims), boxes.where("error is not null").select("box", "error")


def positional_reply(asked: DataFrame, reply: DataFrame) -> DataFrame:
    """(subject, match) of a batched lookup: ``asked`` (ord, subject) and one reply row, a list with a list per subject.

    A reply of another length raises when read.
    """
    lists = reply.select(F.size("lists").alias("n"), F.posexplode("lists").alias("ord", "matches"))
    n = asked.agg(F.count(F.lit(1)).alias("asked"))
    checked = lists.crossJoin(F.broadcast(n)).withColumn("matches", F.when(F.col("n") == F.col("asked"), F.col("matches")).otherwise(F.raise_error(F.lit("a reply must have one list per subject"))))  # one row
    return asked.join(checked.select("ord", "matches"), "ord").select("subject", F.explode("matches").alias("match"))

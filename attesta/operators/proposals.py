"""Rows of the item table from the results of other operators: summary, canonical payload, content id.

Each builder takes a result table and the run's folder, producer and time. Payload structs have their fields in
alphabetical order, which makes their JSON canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.store import canonical_json, content_id


def build(rows: DataFrame, subject_type: str, subject_id: Column, summary: Column, payload: Column, folder: str, producer: str, at: Column, confidence: Column | None = None) -> DataFrame:
    """Item rows in state new. ``payload``: a struct with alphabetical fields."""
    void = lambda kind: F.lit(None).cast(kind)
    text = canonical_json(payload)
    made = rows.select(subject_id.cast("string").alias("subject_id"), summary.alias("summary"), text.alias("payload"), (void("double") if confidence is None else confidence).alias("confidence"))
    return made.select(
        content_id(F.lit(folder), F.lit(subject_type), F.col("subject_id"), F.col("payload")).alias("fingerprint"), F.lit(folder).alias("folder"), F.lit(subject_type).alias("subject_type"), "subject_id",
        "summary", "confidence", "payload", F.lit(producer).alias("producer"), F.lit("new").alias("state"), void("string").alias("prior_state"), void("string").alias("error"),
        at.alias("created_at"), at.alias("last_seen_at"), void("timestamp").alias("resolved_at"),
    )


def scenes(outcomes: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    """Proposals among the outcomes of linkage.examine."""
    rows = outcomes.where("outcome = 'proposal'")
    payload = F.struct("agreeing", "competing", "store", "title", F.col("value").alias("value"))
    return build(rows, "scene", F.col("id"), F.concat(F.col("title"), F.lit(" at "), F.col("store")), payload, folder, producer, at, F.col("value"))


def identified(resolved: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    """Files that exact fingerprints identify; no confidence, as nothing was scored."""
    rows = resolved.where("outcome = 'identified'")
    payload = F.struct("agreeing", "box", F.lit("fingerprint").alias("identified_by"), "perceptual", "site_id")
    return build(rows, "scene", F.col("subject"), F.concat(F.lit("fingerprint known to "), F.col("box")), payload, folder, producer, at)


def label_merges(clusters: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    names = F.array_join("members.name", ", ")
    payload = F.struct("canonical", "members", "undecided")
    return build(clusters, "tag-cluster", F.col("key"), F.concat(F.size("members").cast("string"), F.lit(" spellings: "), names), payload, folder, producer, at)


def label_descriptions(found: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    return build(found, "tag", F.col("id"), F.concat(F.lit("description from "), F.col("source")), F.struct("description", "source"), folder, producer, at)


def label_people(matched: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    """Labels that are people. An unused label, or one without a match, raises."""
    bad = (F.col("scene_count") == 0) | (F.size("matches") == 0)
    checked = matched.withColumn("name", F.when(bad, F.raise_error(F.lit("a label needs scenes and a match"))).otherwise(F.col("name")))
    payload = F.struct("matches", "name", F.col("person_id").alias("resolved"), "scene_count")
    return build(checked, "tag-performer", F.col("id"), F.concat(F.col("name"), F.lit(" is a person")), payload, folder, producer, at)


def unused_labels(judged: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    rows = judged.where("reason = 'proposed'")
    return build(rows, "tag-unused", F.col("id"), F.concat(F.col("name"), F.lit(": "), F.col("usage")), F.struct("name", "scene_count", "usage"), folder, producer, at)


def cleaned_descriptions(outcomes: DataFrame, folder: str, producer: str, at: Column, text: str = "description") -> DataFrame:
    rows = outcomes.where("outcome = 'proposed'")
    payload = F.struct("cleaned", F.split("faults", ",").alias("faults"), F.col(text).alias("original"))
    return build(rows, "performer", F.col("id"), F.concat(F.lit("description has "), F.col("faults")), payload, folder, producer, at)


def enrichments(fields: DataFrame, folder: str, producer: str, at: Column) -> DataFrame:
    """Agreed fields of people, from profiles.fields_map (its entries are sorted)."""
    return build(fields, "performer-enrichment", F.col("id"), F.concat(F.lit("fields: "), F.array_join(F.map_keys("fields"), ", ")), F.struct("fields"), folder, producer, at)


def refusals(outcomes: DataFrame, paths: DataFrame, reports: DataFrame, at: Column) -> DataFrame:
    """Refusal rows of outcomes, with each store's report. ``paths``: (id, path); ``reports``: decisions.store_reports by id."""
    told = reports.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "store", "rows", "score", "title", "url", "error"))), lambda s: s.dropFields("place")).alias("stores"))
    rows = outcomes.where("outcome = 'refusal'").join(paths.select("id", "path"), "id", "left").join(told, "id", "left")
    return rows.select(F.lit("scene").alias("subject_type"), F.col("id").cast("string").alias("subject_id"), "path", "reason", at.alias("at"), "stores")


def mutes(outcomes: DataFrame, at: Column) -> DataFrame:
    """Mute rows of files that no store has."""
    return outcomes.where("outcome = 'mute'").select(F.lit("scene").alias("subject_type"), F.col("id").cast("string").alias("subject_id"), "reason", at.alias("at"))

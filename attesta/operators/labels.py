"""Labels: spelling clusters, description indexes, people behind labels, and hygiene of rare ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import filled, normalize
from attesta.session import written_once


def key_of(name: Column, normal=normalize) -> Column:
    return F.replace(normal(name), F.lit(" "))


def separation(normal_form: Column) -> Column:
    """Words of a normal form."""
    return F.when(normal_form == "", 0).otherwise(F.size(F.split(normal_form, " ")))


def has_description(text: Column) -> Column:
    return ~filled(text).rlike(r"(?U)^\s*$")


def cluster_labels(labels: DataFrame, normal=normalize) -> DataFrame:
    """Labels (id, name, scene_count, description) whose names share a key, two at least.

    key, members sorted by (name, id), canonical (see ``survivor``) and undecided: many, even or null.
    """
    member = F.struct("name", F.col("id").cast("string").alias("id"), "scene_count", "description", "words")
    named = labels.withColumn("__normal", normal(F.col("name")))  # computed once for both
    grouped = (
        named.withColumns({"key": F.replace("__normal", F.lit(" ")), "words": separation(F.col("__normal"))}).where("key <> ''").groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") >= 2)
    )
    return grouped.withColumn("canonical", survivor(F.col("members"))).withColumn("undecided", undecided(F.col("members")))


def survivor(members: Column) -> Column:
    """Id of the member with more words, for two members that differ in it; else null."""
    a, b = members[0], members[1]
    return F.when((F.size(members) == 2) & (a["words"] != b["words"]), F.when(a["words"] > b["words"], a["id"]).otherwise(b["id"]))


def undecided(members: Column) -> Column:
    return F.when(F.size(members) > 2, "many").when(members[0]["words"] == members[1]["words"], "even")


def description_index(rows: DataFrame, normal=normalize) -> DataFrame:
    """Inverted index of a source's (name, aliases, description): key -> description, or ambiguous if two texts claim it."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    told = rows.where(has_description(F.col("description"))).select(F.explode(names).alias("name"), F.trim("description").alias("description"))
    keyed = told.withColumn("key", key_of(F.col("name"), normal)).where("key <> ''")
    grouped = keyed.groupBy("key").agg(F.min("description").alias("description"), F.count_distinct("description").alias("n"))
    return grouped.select("key", F.when(F.col("n") == 1, F.col("description")).alias("description"), (F.col("n") > 1).alias("ambiguous"))


def source_indexes(listings: DataFrame, errors: DataFrame, normal=normalize) -> tuple[DataFrame, DataFrame]:
    """(indexes, unread): description indexes of the sources whose listings were read, and one row with how many were not.

    ``listings``: (source, ord, name, aliases, description); ``errors``: (source, error) of sources whose read failed or ended early. A
    source with an error is left out as a whole: half a listing can't show that a text is the only one.
    """
    bad = errors.where("error is not null").select("source").distinct()
    usable = listings.join(bad, "source", "left_anti").where(has_description(F.col("description")))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = usable.select("source", "ord", F.explode(names).alias("name"), F.trim("description").alias("description")).withColumn("key", key_of(F.col("name"), normal)).where("key <> ''")
    grouped = keyed.groupBy("source", "ord", "key").agg(F.min("description").alias("description"), F.count_distinct("description").alias("n"))
    indexes = grouped.select("key", F.when(F.col("n") == 1, F.col("description")).alias("description"), (F.col("n") > 1).alias("ambiguous"), "source", "ord")
    return indexes, bad.agg(F.count(F.lit(1)).alias("unread"))


def find_descriptions(labels: DataFrame, indexes: DataFrame, normal=normalize) -> DataFrame:
    """The first source, by ordinal, whose index holds a label's key: (id, description, source).

    ``indexes``: description_index rows of all sources with columns source, ord.
    """
    usable = indexes.where("not ambiguous").groupBy("key").agg(F.min_by(F.struct("description", "source"), "ord").alias("first"))
    return labels.withColumn("key", key_of(F.col("name"), normal)).join(usable, "key").select("id", "first.description", "first.source")


def merge_descriptions(clusters: DataFrame) -> DataFrame:
    """What a merge does to the survivor's description.

    outcome: none (no survivor), conflicting (several texts), kept (it has the only one), inherit (from the first
    carrier) or source (nobody has one).
    """
    carriers = F.filter("members", lambda m: has_description(m["description"]))
    texts = F.array_distinct(F.transform(carriers, lambda m: F.trim(m["description"])))
    own = F.exists(carriers, lambda m: m["id"] == F.col("canonical"))
    outcome = F.when(F.col("canonical").isNull(), "none").when(F.size(texts) > 1, "conflicting").when(F.size(texts) == 0, "source").when(own, "kept").otherwise("inherit")
    first = F.try_element_at(carriers, F.lit(1))
    rows = clusters.withColumn("outcome", outcome)
    taken = F.col("outcome") == "inherit"
    return rows.select("key", "canonical", "outcome", F.when(taken, first["id"]).alias("from_id"), F.when(taken, F.trim(first["description"])).alias("description"))


def usage_group(scene_count: Column) -> Column:
    return F.when(scene_count == 0, "no-scenes").when(scene_count == 1, "one-scene")


def index_people(people: DataFrame, normal=normalize) -> DataFrame:
    """key -> matches (name, id, via) over names and aliases, sorted; a person's name beats an alias of the same key."""
    names = people.select("id", "name", F.col("name").alias("spelled"), F.lit(0).alias("via"))
    aliases = people.select("id", "name", F.explode("aliases").alias("spelled"), F.lit(1).alias("via"))
    keyed = names.unionByName(aliases).withColumn("key", key_of(F.col("spelled"), normal)).where("key <> ''")
    one = keyed.groupBy("key", "id", "name").agg(F.min("via").alias("via"))
    match = F.struct("name", F.col("id").cast("string").alias("id"), F.when(F.col("via") == 0, "name").otherwise("alias").alias("via"))
    return one.groupBy("key").agg(F.array_sort(F.collect_list(match)).alias("matches"))


def match_people(labels: DataFrame, index: DataFrame, normal=normalize) -> DataFrame:
    """Labels that carry a person's name: matches, and resolved if there is exactly one and the label is in use."""
    rows = labels.withColumn("key", key_of(F.col("name"), normal)).where("key <> ''").join(index, "key")
    outcome = F.when(F.col("scene_count") == 0, "unused").when(F.size("matches") > 1, "ambiguous").otherwise("resolved")
    return rows.withColumn("outcome", outcome).withColumn("person_id", F.when(F.col("outcome") == "resolved", F.col("matches")[0]["id"]))


def hygiene(labels: DataFrame, sourced: DataFrame, clustered: DataFrame, reconciled: DataFrame, kept: DataFrame, proposed: DataFrame, unread: int | Column = 0) -> DataFrame:
    """Labels on no or one scene with the first reason that holds.

    withheld (any source unread), described, sourced, clustered, reconciled, kept, already, proposed. The five tables
    have one column of ids.
    """
    rows = labels.withColumn("usage", usage_group(F.col("scene_count"))).where("usage is not null")
    for name, ids in (("sourced", sourced), ("clustered", clustered), ("reconciled", reconciled), ("kept", kept), ("already", proposed)):
        rows = rows.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn(f"__{name}", F.lit(True)), "id", "left")
    reason = F.when((unread if isinstance(unread, Column) else F.lit(unread)) > 0, "withheld").when(has_description(F.col("description")), "described")
    for name in ("sourced", "clustered", "reconciled", "kept", "already"):
        reason = reason.when(F.col(f"__{name}"), name)
    return rows.withColumn("reason", reason.otherwise("proposed")).drop(*[f"__{n}" for n in ("sourced", "clustered", "reconciled", "kept", "already")])


def label_pass(labels: DataFrame, people: DataFrame, indexes: DataFrame, muted: DataFrame, proposed: DataFrame, unread: int = 0, normal=normalize) -> dict[str, DataFrame]:
    """The four passes over one read of labels: merge, describe, reconcile, hygiene; later ones skip ids of earlier ones.

    ``labels`` is written once for them.
    """
    labels = written_once(labels)
    clusters = cluster_labels(labels, normal)
    in_cluster = clusters.select(F.explode("members.id").alias("id"))
    bare = labels.where(~has_description(F.col("description"))).join(in_cluster, "id", "left_anti")
    described = find_descriptions(bare, indexes, normal)
    matched = match_people(labels, index_people(people, normal), normal)
    reconcile = matched.join(in_cluster, "id", "left_anti").join(muted, "id", "left_anti")
    sourced = find_descriptions(labels, indexes, normal).select("id")
    return {
        "merge": clusters,
        "describe": described,
        "reconcile": reconcile,
        "hygiene": hygiene(labels, sourced, in_cluster, reconcile.where("outcome = 'resolved'").select("id"), muted, proposed, unread),
    }


def summary(counts: DataFrame, what: str) -> DataFrame:
    """One line of text over (reason, n) rows."""
    part = F.struct(F.col("reason"), F.concat_ws(" ", F.col("n").cast("string"), "reason").alias("text"))
    return counts.agg(F.concat(F.lit(f"{what}: "), F.array_join(F.array_sort(F.collect_list(part))["text"], ", ")).alias("summary"))

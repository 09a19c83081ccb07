"""Write plans: what applying a proposal changes, and the snapshot that undoes it.

Each function returns a change-set table to be written as one; nothing is written here. Guards refuse by a reason
column, so one bad row never stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import filled, strip_html
from attesta.session import few, written_once

CHUNK = 200


def union_ids(existing: Column, new: Column, dropped: Column | None = None) -> Column:
    """Existing ids, then new ones, in order and once, without dropped ones."""
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(existing, none), F.coalesce(new, none))
    return both if dropped is None else F.array_except(both, F.coalesce(dropped, none))


def catalogue_link(endpoint: Column, stash_id: Column) -> Column:
    ok = (filled(endpoint) != "") & (filled(stash_id) != "")
    return F.when(ok, F.struct(endpoint.alias("endpoint"), stash_id.alias("stash_id")))


def with_link(stash_ids: Column, link: Column) -> Column:
    """A candidate's source ids with the catalogue link at the end."""
    none = F.array().cast("array<struct<endpoint: string, stash_id: string>>")
    return F.concat(F.coalesce(stash_ids, none), F.array_compact(F.array(link)))


def merge_links(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """(key, endpoint, stash_id, conflict): source ids merged by endpoint; another value for a known endpoint conflicts."""
    rows = existing.select(key, "endpoint", "stash_id", F.lit(0).alias("side")).unionByName(incoming.select(key, "endpoint", "stash_id", F.lit(1).alias("side")))
    return rows.groupBy(key, "endpoint").agg(F.min_by("stash_id", F.struct("side", "stash_id")).alias("stash_id"), (F.count_distinct("stash_id") > 1).alias("conflict"))


def scene_changes(scenes: DataFrame, matches: DataFrame, overwrite_studio: bool = False) -> DataFrame:
    """One change per matched scene, with everything it replaces in ``prior``.

    Scalars change only if the match has them; people and tags are added to the existing ones, dropped tags leave;
    the studio changes if there is none or ``overwrite_studio``; skipped names the fields that stay.
    """
    m = matches.select("id", *[F.col(c).alias(f"m_{c}") for c in matches.columns if c != "id"])
    rows = scenes.join(m, "id")
    clean = lambda c: F.nullif(strip_html(F.col(c)), F.lit(""))
    title, details = clean("m_title"), clean("m_details")
    date = F.nullif(F.col("m_date"), F.lit(""))
    takes = F.col("m_studio_id").isNotNull() & (F.col("studio_id").isNull() | F.lit(overwrite_studio))
    flags = {"title": title.isNull(), "details": details.isNull(), "date": date.isNull(), "studio": ~takes}
    return rows.select(
        "id", F.coalesce(title, "title").alias("title"), F.coalesce(details, "details").alias("details"), F.coalesce(date, "date").alias("date"),
        F.when(takes, F.col("m_studio_id")).otherwise(F.col("studio_id")).alias("studio_id"),
        union_ids(F.col("performer_ids"), F.col("m_performer_ids")).alias("performer_ids"),
        union_ids(F.col("tag_ids"), F.col("m_tag_ids"), F.col("m_drop_tag_ids")).alias("tag_ids"),
        F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()])).alias("skipped"),
        F.struct(*[F.col(c) for c in ("title", "details", "date", "studio_id", "performer_ids", "tag_ids")]).alias("prior"),
    )


def revert_scenes(scenes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Scenes with exactly the snapshot's values; an empty snapshot raises."""
    prior = snapshots.select("id", F.when(F.col("prior").isNull(), F.raise_error(F.lit("nothing to restore"))).otherwise(F.col("prior")).alias("p"))
    fields = ("title", "details", "date", "studio_id", "performer_ids", "tag_ids")
    rows = scenes.join(prior.withColumn("__hit", F.lit(True)), "id", "left")
    return rows.withColumns({c: F.when(F.col("__hit"), F.col(f"p.{c}")).otherwise(F.col(c)) for c in fields}).select(*scenes.columns)


def find_or_create(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, stored_id) -> id: the stored one, else an entity of that name, else one of that alias; created marks the rest.

    Names are compared trimmed and in lower case; a blank one without a stored id has none.
    """
    key = F.lower(F.trim(filled(F.col("name"))))
    by_name = entities.select(F.lower(F.trim("name")).alias("__key"), "id", F.lit(0).alias("rank"))
    by_alias = entities.select(F.explode("aliases").alias("a"), "id").select(F.lower(F.trim("a")).alias("__key"), "id", F.lit(1).alias("rank"))
    found = by_name.unionByName(by_alias).where("__key <> ''").groupBy("__key").agg(F.min_by("id", F.struct("rank", "id")).alias("found_id"))
    rows = names.withColumn("__key", key).join(found, "__key", "left")
    fresh = F.col("stored_id").isNull() & F.col("found_id").isNull() & (F.col("__key") != "")
    made = F.when(fresh, F.concat(F.lit("new-"), F.sha2("__key", 256)))
    return rows.select("name", "stored_id", F.coalesce("stored_id", "found_id", made).alias("id"), fresh.alias("created"))


def compare_and_set(current: DataFrame, wanted: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(key, new, prior, refused): the new value where the current one is still the expected one (null-safe)."""
    rows = wanted.join(current.select(key, F.col(column).alias("prior")).withColumn("__there", F.lit(True)), key, "left")
    refused = F.when(F.col("__there").isNull(), "missing").when(~F.col("prior").eqNullSafe(F.col("expected")), "changed meanwhile")
    return rows.select(key, F.when(refused.isNull(), F.col("value")).otherwise(F.col("prior")).alias("new"), "prior", refused.alias("refused"))


def fill_blanks(current: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Fields of ``wanted`` (key, field, value) set where blank in ``current`` (same shape); one filled field refuses all of a key."""
    rows = wanted.join(current.select(key, "field", F.col("value").alias("now")), [key, "field"], "left")
    taken = rows.groupBy(key).agg(F.bool_or(filled(F.col("now")) != "").alias("refused"))
    return rows.join(taken, key).select(key, "field", F.when(~F.col("refused"), F.col("value")).otherwise(F.col("now")).alias("value"), F.col("now").alias("prior"), "refused")


def merge_entities(associations: DataFrame, merges: DataFrame, owner: str = "scene_id", entity: str = "tag_id") -> DataFrame:
    """Associations with losers rewritten to their survivor, repeats dropped. ``merges``: (loser, survivor)."""
    rows = associations.join(merges.select(F.col("loser").alias(entity), "survivor"), entity, "left")
    return rows.select(owner, F.coalesce("survivor", entity).alias(entity)).distinct()


def merge_guard(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges with a reason against them: a description may not be carried onto one that is not blank."""
    rows = merges.join(entities.select(F.col("id").alias("survivor"), F.col("description").alias("own")), "survivor", "left")
    clash = (filled(F.col("description")) != "") & (filled(F.col("own")) != "")
    return rows.withColumn("refused", F.when(clash, "the survivor has a description")).drop("own")


def guarded_delete(entities: DataFrame, deletions: DataFrame) -> DataFrame:
    """Entities without those whose scene_count is still the expected one."""
    return entities.join(deletions.select("id", F.col("expected").alias("scene_count")), ["id", "scene_count"], "left_anti")


def reconciled(scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scenes (one row per id) of each (tag_id, performer_id).

    The lists of a scene are those after all of its pairs: their performers added, their tags removed, the same on each
    of its rows. attached: whether the performer is new there, which is what an undo takes away again.

    Scenes dealt by id stay so: a few pairs (see ``few``) are broadcast, so no list is moved or kept.
    """
    hit = scenes.where("id is not null").select("id", "performer_ids", "tag_ids", F.explode("tag_ids").alias("tag_id")).join(few(written_once(pairs)), "tag_id")
    every = hit.groupBy("id", "performer_ids", "tag_ids").agg(F.collect_set(F.struct("tag_id", "performer_id")).alias("pairs"))
    new = F.array_sort(F.array_compact(F.array_distinct("pairs.performer_id")))
    rows = every.select(F.explode("pairs").alias("pair"), "id", union_ids(F.col("performer_ids"), new).alias("after"), F.array_except("tag_ids", "pairs.tag_id").alias("tag_ids"), "performer_ids")
    return rows.select(
        "pair.tag_id", "pair.performer_id", "id", F.col("after").alias("performer_ids"), "tag_ids", (~F.array_contains("performer_ids", F.col("pair.performer_id"))).alias("attached")
    )


def reconcile(scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``reconciled`` with chunk numbers for bulk writes; ranking them keeps all rows once in the shared folder."""
    from attesta.operators.selection import chunks

    return chunks(reconciled(scenes, pairs), "id", CHUNK, "tag_id")


def revert_reconcile(scenes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Undoes reconcile: tags return to its scenes, performers leave those where they were attached."""
    undo = snapshot.groupBy("id").agg(
        F.array_sort(F.collect_set("tag_id")).alias("__tags"), F.collect_set(F.when(F.col("attached"), F.col("performer_id"))).alias("__people")
    )
    rows = scenes.join(undo, "id", "left")
    tags = F.when(F.col("__tags").isNotNull(), union_ids(F.col("tag_ids"), F.col("__tags"))).otherwise(F.col("tag_ids"))
    people = F.when(F.size("__people") > 0, F.array_except("performer_ids", "__people")).otherwise(F.col("performer_ids"))
    return rows.withColumns({"tag_ids": tags, "performer_ids": people}).select(*scenes.columns)


def bulk_mode(mode: str) -> str:
    """ADD or REMOVE; replacing whole lists in bulk is refused."""
    if mode not in ("ADD", "REMOVE"):
        raise ValueError(f"a bulk write adds or removes, not {mode!r}")
    return mode


def replace_aliases(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    rows = entities.join(wanted.select("id", F.col("aliases").alias("__new")).withColumn("__hit", F.lit(True)), "id", "left")
    return rows.withColumn("aliases", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("aliases"))).select(*entities.columns)


# Nested profiles


def joined_modifications(items: Column) -> Column:
    """``location: description`` texts joined by '; ', null if there are none."""
    none = F.array().cast("array<struct<location: string, description: string>>")
    text = F.transform(F.coalesce(items, none), lambda m: F.concat_ws(": ", F.nullif(m["location"], F.lit("")), F.nullif(m["description"], F.lit(""))))
    return F.nullif(F.array_join(F.filter(text, lambda x: x != ""), "; "), F.lit(""))


def career_length(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull(), F.concat(start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit(""))))


def profile_fields(raw: DataFrame) -> DataFrame:
    """Nested profiles as flat fields, '' as null: id, name, aliases and thirteen fields."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.select(
        "id", "name", "aliases", text("disambiguation").alias("disambiguation"), text("gender").alias("gender"), text("birthdate").alias("birthdate"),
        text("ethnicity").alias("ethnicity"), text("country").alias("country"), text("eye_color").alias("eye_color"), text("measurements").alias("measurements"),
        "height_cm", career_length(F.col("career_start"), F.col("career_end")).alias("career_length"), joined_modifications(F.col("tattoos")).alias("tattoos"),
        joined_modifications(F.col("piercings")).alias("piercings"), F.col("urls.url").alias("urls"), F.try_element_at(F.col("images.url"), F.lit(1)).alias("image"),
    )

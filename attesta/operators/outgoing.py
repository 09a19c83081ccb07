"""From approved proposals to changes for the sink, from its outcomes back to items, and the way back: undo by fields.

Changes are rows (change_id, kind, subject_id, edits) of sources.outbox; ``refused`` rows are proposals that no write can be made
from. A reconciliation is one change per chunk of scenes, named ``fingerprint:chunk``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import changes, store

#: Fields that apply takes over from a match, and how.
LINK = "array<struct<endpoint: string, stash_id: string>>"
MATCH = f"id string, title string, details string, date string, urls array<string>, stash_ids {LINK}, studio_id string, performer_ids array<string>, tag_ids array<string>, drop_tag_ids array<string>, image string"
PAYLOADS = {
    "performer": "cleaned string, original string",
    "performer-enrichment": "fields map<string, string>",
    "tag": "description string, source string",
    "tag-cluster": "canonical struct<id: string>, members array<struct<id: string>>, undecided string, description string",
    "tag-performer": "resolved string, matches array<struct<id: string>>",
    "tag-unused": "scene_count bigint",
}
LISTS = ("alias_list", "urls")
ROUTED = ["change_id", "kind", "subject_id", "edits", "fingerprint", "refused"]


def _json(edits: Column) -> Column:
    return F.to_json(edits, {"ignoreNullFields": "true"})


def scene_edits(matches: DataFrame, overwrite_studio: bool = False) -> DataFrame:
    """(subject_id, edits) of matches (columns of MATCH, missing ones count as null) whose names are resolved to ids."""
    m = store.add_missing_columns(matches, MATCH)
    clean = lambda c: F.nullif(changes.strip_html(F.col(c)), F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    put = lambda v: F.when(v.isNotNull(), F.struct(v.alias("set")))
    listed = lambda add, drop=None: F.when((F.size(F.coalesce(add, F.array())) > 0) | (F.lit(False) if drop is None else F.size(F.coalesce(drop, F.array())) > 0), F.struct(add.alias("add"), *([] if drop is None else [drop.alias("drop")])))
    studio = F.struct(F.col("studio_id").alias("set" if overwrite_studio else "claim"))
    edits = F.struct(
        put(clean("title")).alias("title"), put(clean("details")).alias("details"), put(F.nullif(F.col("date"), F.lit(""))).alias("date"), put(some("urls")).alias("urls"),
        F.when(F.size("stash_ids") > 0, F.struct(F.col("stash_ids").alias("links"))).alias("stash_ids"), F.when(F.col("studio_id").isNotNull(), studio).alias("studio_id"),
        listed(F.col("performer_ids")).alias("performer_ids"), listed(F.col("tag_ids"), F.col("drop_tag_ids")).alias("tag_ids"),
        put(F.nullif(F.col("image"), F.lit(""))).alias("cover_image"), F.struct(F.lit(True).alias("set")).alias("organized"),
    )
    return m.select(F.col("id").alias("subject_id"), _json(edits).alias("edits"))


def reconciliation_edits(scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fingerprint, chunk, edits, attached, untagged) of (fingerprint, tag_id, performer_id): a bulk write for each chunk of a tag's scenes."""
    hit = scenes.select("id", "performer_ids", F.explode("tag_ids").alias("tag_id")).join(pairs, "tag_id")
    # whether the person is new to a scene is told before rows are ranked, so no list of people travels with them
    hit = hit.withColumn("new", ~F.array_contains("performer_ids", F.col("performer_id"))).drop("performer_ids")
    from attesta.operators.selection import chunks

    rows = chunks(hit, "id", changes.CHUNK, "fingerprint")
    made = rows.groupBy("fingerprint", "chunk", "tag_id", "performer_id").agg(
        F.array_sort(F.collect_list("id")).alias("untagged"), F.array_sort(F.collect_list(F.when(F.col("new"), F.col("id")))).alias("attached")
    )
    mode = lambda c, m: F.struct(F.array(F.col(c)).alias("ids"), F.lit(m).alias("mode"))
    edits = F.struct(F.col("untagged").alias("ids"), mode("performer_id", "ADD").alias("performer_ids"), mode("tag_id", "REMOVE").alias("tag_ids"))
    return made.select("fingerprint", "chunk", "tag_id", "performer_id", _json(edits).alias("edits"), "attached", "untagged")


def routed(items: DataFrame, matches: DataFrame | None = None, scenes: DataFrame | None = None) -> DataFrame:
    """Changes of approved items by subject type (columns ROUTED).

    ``matches``: resolved matches of scene proposals by id; ``scenes``: (id, performer_ids, tag_ids), for reconciliations. A
    proposal that leaves the choice open (an undecided cluster, a label of several people), one that would run a second time
    over a snapshot, and one whose match or type is not known are refused.
    """
    of = lambda kind: items.where(F.col("subject_type") == kind).withColumn("p", F.from_json("payload", PAYLOADS[kind]))
    no = F.lit(None).cast("string")

    def out(rows: DataFrame, kind: str, edits: Column, refused: Column = no, subject: Column | None = None) -> DataFrame:
        return rows.select(F.col("fingerprint").alias("change_id"), F.lit(kind).alias("kind"), (F.col("subject_id") if subject is None else subject).alias("subject_id"), edits.alias("edits"), "fingerprint", refused.alias("refused"))

    guarded = F.struct(F.struct(F.col("p.cleaned").alias("set"), F.col("p.original").alias("expected")).alias("details"))
    # without the text that it was made from, a description can't be guarded
    parts = [out(of("performer"), "performer", _json(guarded), F.when(F.col("p.original").isNull() | F.col("p.cleaned").isNull(), "no original text"))]
    as_list = lambda v: F.from_json(v, "array<string>")
    parts.append(
        out(
            of("performer-enrichment").withColumn("lists", F.map_filter("p.fields", lambda k, v: k.isin(*LISTS))).withColumn("texts", F.map_filter("p.fields", lambda k, v: ~k.isin(*LISTS))),
            "performer",
            F.concat(
                F.lit("{"),
                F.concat_ws(
                    ",",
                    F.transform(F.map_entries("texts"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(e["key"] == "height_cm", F.to_json(F.struct(e["value"].try_cast("int").alias("fill")))).otherwise(F.to_json(F.struct(e["value"].alias("fill")))))),
                    F.transform(F.map_entries("lists"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(F.struct(F.coalesce(as_list(e["value"]), F.array(e["value"])).alias("fill"))))),
                ),
                F.lit("}"),
            ),
            F.when(F.size("p.fields") < 1, "no fields"),
        )
    )
    parts.append(out(of("tag"), "tag", _json(F.struct(F.struct(F.col("p.description").alias("fill")).alias("description")))))
    losers = F.filter("p.members.id", lambda i: i != F.col("p.canonical.id"))
    merge = F.struct(F.struct(losers.alias("set")).alias("sources"), F.when(F.col("p.description").isNotNull(), F.struct(F.col("p.description").alias("set"))).alias("description"))
    undecided = F.when(F.col("p.canonical").isNull(), F.concat(F.lit("no agreed surviving spelling: "), F.coalesce("p.undecided", F.lit("undecided"))))
    parts.append(out(of("tag-cluster"), "tag-merge", _json(merge), undecided, F.coalesce("p.canonical.id", "subject_id")))
    parts.append(out(of("tag-unused"), "tag-delete", _json(F.struct(F.struct(F.col("p.scene_count").alias("expected")).alias("scene_count"))), F.when(F.col("p.scene_count").isNull(), "no recorded count")))
    known = items.where("subject_type = 'scene'")
    if matches is None:
        parts.append(out(known, "scene", no, F.lit("no match")))
    else:
        edits = scene_edits(matches).withColumnRenamed("edits", "own")
        parts.append(out(known.join(edits, "subject_id", "left"), "scene", F.col("own"), F.when(F.col("own").isNull(), "no match")))
    people = of("tag-performer").select("fingerprint", F.col("subject_id").alias("tag_id"), F.col("p.resolved").alias("performer_id"), F.col("prior_state").alias("was"))
    why = F.when(F.col("performer_id").isNull(), "several people answer to its name").when(F.col("was").isNotNull(), "an earlier attempt changed some scenes; undo it first")
    people = people.withColumn("refused", why)
    stopped = people.where("refused is not null").select(F.col("fingerprint").alias("change_id"), F.lit("scenes").alias("kind"), F.col("tag_id").alias("subject_id"), no.alias("edits"), "fingerprint", "refused")
    parts.append(stopped)
    if scenes is not None:
        bulk = reconciliation_edits(scenes, people.where("refused is null").select("fingerprint", "tag_id", "performer_id"))
        parts.append(bulk.select(F.concat_ws(":", "fingerprint", "chunk").alias("change_id"), F.lit("scenes").alias("kind"), F.col("tag_id").alias("subject_id"), "edits", "fingerprint", no.alias("refused")))
    types = [*PAYLOADS, "scene"]
    parts.append(out(items.where(~F.col("subject_type").isin(*types)), "none", no, F.lit("no write for its type")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.withColumn("edits", F.when(F.col("refused").isNull(), F.col("edits"))).select(*ROUTED)


def attempts(routes: DataFrame, outcomes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(fingerprint, error, prior_state, written) per proposal, for actions.approve: the first error of its changes, the snapshot of what landed.

    ``chunks``: reconciliation_edits, whose snapshot is the scenes of the chunks that were written, so a partly failed one can be undone.
    """
    rows = routes.join(outcomes.drop("kind", "subject_id"), "change_id", "left")
    error = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("verdict").isNull(), "not attempted").when(F.col("verdict") != "applied", F.coalesce("reason", "verdict"))
    seen = rows.withColumn("error", error)
    done = seen.groupBy("fingerprint").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("change_id"))).alias("error"), F.min("prior").alias("prior_state"), F.min("written").alias("written"))
    if chunks is None:
        return done
    landed = seen.where("verdict = 'applied' and kind = 'scenes'").select("change_id")
    own = chunks.withColumn("change_id", F.concat_ws(":", "fingerprint", "chunk")).join(landed, "change_id")
    lists = own.groupBy("fingerprint", "tag_id", "performer_id").agg(F.array_sort(F.flatten(F.collect_list("attached"))).alias("attached"), F.array_sort(F.flatten(F.collect_list("untagged"))).alias("untagged"))
    bulk = lists.select("fingerprint", store.canonical_json(F.struct("attached", "performer_id", "tag_id", "untagged")).alias("scenes_prior"))
    return done.join(bulk, "fingerprint", "left").withColumn("prior_state", F.coalesce("scenes_prior", "prior_state")).drop("scenes_prior")


# Undo


def fields_of(rows: DataFrame, state: str, *keys: str) -> DataFrame:
    """(keys, field, value): each field of a JSON object column as canonical JSON of its own."""
    own = rows.select(*keys, F.try_parse_json(F.col(state)).alias("__state"))
    each = own.lateralJoin(own.sparkSession.tvf.variant_explode(F.col("__state").outer()))
    return each.select(*keys, F.col("key").alias("field"), F.to_json("value").alias("value"))


def undo_fields(items: DataFrame, written: DataFrame, present: DataFrame) -> DataFrame:
    """What an undo does to each field that an applied proposal wrote: a three-way comparison.

    ``items`` with prior_state, ``written`` (fingerprint, written) from the outcomes, ``present`` (subject_type, subject_id, state),
    all states JSON objects. verdict: ``restore`` (the field still holds what was written), ``restored`` (it holds what was there
    before), ``changed meanwhile``, or ``gone`` (no such subject). A field with the same value before and after has nothing to undo.
    """
    of = items.where(F.col("state").isin(*store.SETTLED) & F.col("prior_state").isNotNull()).select("fingerprint", *store.SUBJECT, "prior_state")
    prior = fields_of(of, "prior_state", "fingerprint", *store.SUBJECT).withColumnRenamed("value", "prior")
    wrote = fields_of(written.join(of.select("fingerprint"), "fingerprint"), "written", "fingerprint").withColumnRenamed("value", "written")
    rows = prior.join(wrote, ["fingerprint", "field"])
    now = fields_of(present, "state", *store.SUBJECT).withColumnRenamed("value", "present")
    there = present.select(*store.SUBJECT).distinct().withColumn("__there", F.lit(True))
    rows = rows.join(there, store.SUBJECT, "left").join(now, [*store.SUBJECT, "field"], "left")
    same = lambda a, b: F.coalesce(a, F.lit("null")) == F.coalesce(b, F.lit("null"))
    verdict = (
        F.when(F.col("__there").isNull(), "gone")
        .when(same(F.col("present"), F.col("prior")), "restored")
        .when(same(F.col("present"), F.col("written")), "restore")
        .otherwise("changed meanwhile")
    )
    return rows.where(~same(F.col("prior"), F.col("written"))).select("fingerprint", *store.SUBJECT, "field", "prior", "written", "present", verdict.alias("verdict"))


def undo_changes(fields: DataFrame, whole: bool = True) -> DataFrame:
    """Changes (columns of the sink) that put fields back; each still guarded by the value that was written.

    ``whole``: a proposal with a field that changed meanwhile, or whose subject is gone, is left alone; otherwise its other fields are put back.
    """
    bad = F.col("verdict").isin("changed meanwhile", "gone")
    if whole:
        stopped = fields.where(bad).select("fingerprint").distinct()
        fields = fields.join(stopped, "fingerprint", "left_anti")
    edit = F.concat(F.to_json(F.struct("field")).substr(F.lit(10), F.length(F.to_json(F.struct("field"))) - 10), F.lit(':{"set":'), F.coalesce("prior", F.lit("null")), F.lit(',"expected":'), F.coalesce("written", F.lit("null")), F.lit("}"))
    rows = fields.where("verdict = 'restore'").groupBy("fingerprint", *store.SUBJECT).agg(F.array_join(F.array_sort(F.collect_list(edit)), ",").alias("body"))
    kind = F.when(F.col("subject_type") == "scene", "scene").when(F.col("subject_type").startswith("performer"), "performer").otherwise("tag")
    return rows.select(F.concat(F.lit("undo:"), F.col("fingerprint")).alias("change_id"), kind.alias("kind"), "subject_id", F.concat(F.lit("{"), F.col("body"), F.lit("}")).alias("edits"), "fingerprint")


def undo_reconciliations(items: DataFrame) -> DataFrame:
    """Bulk changes that undo reconciliations from their snapshots: the tag returns to its scenes first, then the person leaves those where it was attached.

    The order of the two is the order of ``step``; both may be said twice.
    """
    schema = "attached array<string>, performer_id string, tag_id string, untagged array<string>"
    known = items.where((F.col("subject_type") == "tag-performer") & F.col("state").isin(*store.SETTLED) & F.col("prior_state").isNotNull())
    p = known.withColumn("p", F.from_json("prior_state", schema))
    wrong = F.col("p.tag_id").isNull() | F.col("p.performer_id").isNull() | F.col("p.untagged").isNull() | F.col("p.attached").isNull() | (F.col("p.tag_id") != F.col("subject_id"))
    p = p.withColumn("fingerprint", F.when(wrong, F.raise_error(F.lit("the snapshot does not name this tag, a person and both lists of scenes"))).otherwise(F.col("fingerprint")))
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / changes.CHUNK).cast("int")), lambda k: F.slice(c, k * changes.CHUNK + 1, changes.CHUNK))
    mode = lambda c, m: F.struct(F.array(F.col(c)).alias("ids"), F.lit(m).alias("mode"))

    def half(step: int, scenes: str, field: str, value: str, how: str) -> DataFrame:
        rows = p.where(F.size(F.col(scenes)) > 0).select("fingerprint", "subject_id", "p", F.posexplode(cut(F.col(scenes))).alias("k", "ids"))
        edits = _json(F.struct("ids", mode(value, how).alias(field)))
        return rows.select(F.concat_ws(":", F.lit("undo"), "fingerprint", F.lit(step), "k").alias("change_id"), F.lit("scenes").alias("kind"), "subject_id", edits.alias("edits"), "fingerprint", F.lit(step).alias("step"))

    return half(0, "p.untagged", "tag_ids", "p.tag_id", "ADD").unionByName(half(1, "p.attached", "performer_ids", "p.performer_id", "REMOVE"))


def missing_entities(names: DataFrame, kind: str) -> DataFrame:
    """Changes that create entities which changes.find_or_create marked as new, one per name; their outcomes' reply_id is the id."""
    fresh = names.where("created").groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min(F.trim("name")).alias("name"))
    edits = _json(F.struct(F.struct(F.col("name").alias("set")).alias("name")))
    return fresh.select(F.concat(F.lit(f"create:{kind}:"), F.sha2("key", 256)).alias("change_id"), F.lit(f"{kind}-create").alias("kind"), F.concat(F.lit("new-"), F.sha2("key", 256)).alias("subject_id"), edits.alias("edits"))


def with_created(ids: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``ids`` (name, stored_id, id, created) with the ids that creating gave; a name the server refused keeps none, with its error."""
    made = outcomes.select(F.col("subject_id").alias("id"), F.col("reply_id"), F.when(F.col("verdict") != "applied", F.col("reason")).alias("error"))
    rows = ids.join(made, "id", "left")
    return rows.select("name", "stored_id", F.when(F.col("created"), F.col("reply_id")).otherwise(F.col("id")).alias("id"), "created", "error")

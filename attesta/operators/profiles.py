"""People: ids by source, blank fields, offers of other sources, and cleaning of descriptions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import filled, spaceless
from attesta.functions.vocab import LIST_FIELDS, NAMED_REFERENCES, TAG_NAMES
from attesta.session import spread


def stash_id_at(stash_ids: Column, endpoint: str) -> Column:
    return F.try_element_at(F.filter(stash_ids, lambda s: s["endpoint"] == endpoint), F.lit(1))["stash_id"]


def derive_ids(rows: DataFrame, name: str = "name", site_id: str = "site_id") -> DataFrame:
    """(name, site_id, ambiguous): the id of names with one, the sorted ids of names with several."""
    ids = rows.where(F.col(site_id).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.array_sort(F.collect_set(site_id)).alias("ids"))
    one = F.size("ids") == 1
    return ids.select("name", F.when(one, F.col("ids")[0]).alias("site_id"), F.when(~one, F.col("ids")).alias("ambiguous"))


def merge_ids(manual: DataFrame, derived: DataFrame) -> DataFrame:
    """(name, site_id, unresolved): manual ids override; ambiguous names without one stay unresolved."""
    rows = manual.select("name", F.col("site_id").alias("__manual")).join(derived, "name", "full_outer")
    found = F.coalesce("__manual", "site_id")
    return rows.select("name", found.alias("site_id"), found.isNull().alias("unresolved"))


def is_blank(value: Column, is_list: bool = False) -> Column:
    return (value.isNull() | (F.size(value) == 0)) if is_list else (value.isNull() | (value.cast("string") == ""))


def lacks_image(image_path: Column) -> Column:
    return F.coalesce(image_path, F.lit("")).rlike("^$|default=true")


def missing_fields(fields: tuple[str, ...], lists: tuple[str, ...] = LIST_FIELDS, image: str | None = "image_path") -> Column:
    """Names of a row's blank fields, in order; ``image`` if its path is a placeholder."""
    flags = [F.when(is_blank(F.col(f), f in lists), F.lit(f)) for f in fields]
    if image:
        flags.append(F.when(lacks_image(F.col(image)), F.lit("image")))
    return F.array_compact(F.array(*flags))


def matches_name(name: Column, candidate: Column, aliases: Column) -> Column:
    key = spaceless(name)
    return (key != "") & ((key == spaceless(candidate)) | F.array_contains(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), spaceless), key))


def field_key(value: Column, kind: str = "text") -> Column:
    """What two offers of a field are compared by: a text's slug, a number itself, a list's set of slugs."""
    if kind == "list":
        return F.array_join(F.array_sort(F.array_distinct(F.transform(value, spaceless))), "\x1f")
    return value.cast("string") if kind == "number" else spaceless(value)


def merge_offers(offers: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per (id, field) of (id, field, ord, source, value) offers: the first value if all share a key, else every offer."""
    rows = offers.where(F.col("value").isNotNull() & (F.col("value") != "")).withColumn("__key", spaceless(F.col("value")) if key is None else key)
    grouped = rows.groupBy("id", "field").agg(
        F.count_distinct("__key").alias("n"), F.min_by("value", "ord").alias("value"), F.array_sort(F.collect_list(F.struct("ord", "source", "value"))).alias("offers")
    )
    agreed = F.col("n") == 1
    return grouped.select("id", "field", agreed.alias("agreed"), F.when(agreed, F.col("value")).alias("value"), F.when(~agreed, F.col("offers")).alias("conflict"))


def enrichment_candidates(people: DataFrame, profiles: DataFrame, endpoint: str) -> DataFrame:
    """Each person's profiles in a source: the one of their id there; without an id, those that share a name."""
    rows = people.withColumn("site_id", stash_id_at(F.col("stash_ids"), endpoint))
    mine = profiles.select(F.col("id").alias("site_id"), F.struct(*profiles.columns).alias("profile"))
    known = rows.where("site_id is not null").join(mine, "site_id").select(rows["id"], "profile")
    spelled = profiles.select(
        F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), spaceless))).alias("key"), F.struct(*profiles.columns).alias("profile")
    ).where("key <> ''")
    named = rows.where("site_id is null").withColumn("key", spaceless(F.col("name"))).join(spelled, "key").select("id", "profile")
    return known.unionByName(named)


def enrichment_budget(people: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` people by id that miss a field (a budget of lookups)."""
    return people.where(F.size("missing") > 0).orderBy("id").limit(limit)


def fields_map(merged: DataFrame) -> DataFrame:
    """Agreed fields of each person as one map."""
    return merged.where("agreed").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


# Descriptions

_TAG = r"</?(?:" + "|".join(sorted(TAG_NAMES, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>"
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|" + "|".join(sorted(NAMED_REFERENCES)) + ");"
DOUBLE, UNSAFE, NOTHING = "double encoded", "unsafe reference", "nothing left"


def faults(text: Column) -> Column:
    """What is wrong with a description: markup, entity, both or nothing."""
    return F.array_compact(F.array(F.when(text.rlike(f"(?iU){_TAG}"), "markup"), F.when(text.rlike(_REFERENCE), "entity")))


def tidy(text: Column) -> Column:
    """Blanks around line breaks and at both ends dropped; the breaks stay."""
    return F.regexp_replace(F.regexp_replace(filled(text), r"[ \t]*\n[ \t]*", "\n"), r"(?U)^\s+|\s+$", "")


def decoded(text: str) -> str | None:
    """References decoded once; None if one names no printable character."""

    def char(found: re.Match) -> str:
        body = found[0][1:-1]
        if not body.startswith("#"):
            return NAMED_REFERENCES[body]
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        if code > 0x10FFFF or not chr(code).isprintable():
            raise ValueError(body)
        return chr(code)

    try:
        return re.sub(_REFERENCE, char, text)
    except ValueError:
        return None


CLEANUP = T.StructType([T.StructField("faults", T.StringType()), T.StructField("cleaned", T.StringType()), T.StructField("reason", T.StringType())])


def cleanup(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(faults, cleaned, reason) of a description; all None if nothing is wrong.

    Runs of tags become one space, then references are decoded once. The result is offered only if it has no fault.
    """
    tag, ref = re.compile(_TAG, re.I), re.compile(_REFERENCE)
    told = lambda x: ",".join(n for n, p in (("markup", tag), ("entity", ref)) if p.search(x))
    found = told(text) if text else ""
    if not found:
        return None, None, None
    plain = decoded(re.sub(rf"[ \t]*(?:(?:{_TAG})[ \t]*)+", " ", text, flags=re.I))
    if plain is None:
        return found, None, UNSAFE
    plain = re.sub(r"[ \t]*\n[ \t]*", "\n", plain).strip()
    if not plain:
        return found, None, NOTHING
    return (found, None, DOUBLE) if told(plain) else (found, plain, None)


@F.pandas_udf(CLEANUP)
def assess(texts: pd.Series) -> pd.DataFrame:
    """cleanup over Arrow batches (a callback per reference has no expression)."""
    return pd.DataFrame([cleanup(x) for x in texts], columns=["faults", "cleaned", "reason"], dtype=object)


def description_outcomes(rows: DataFrame, text: str = "description") -> DataFrame:
    """Rows with faults, cleaned, reason and outcome: clean, proposed or refused."""
    # only texts with a fault go to Python; the rest are told in the JVM
    found = rows.withColumn("__c", assess(F.when(F.size(faults(filled(F.col(text)))) > 0, F.col(text))))
    outcome = F.when(F.col("__c.faults").isNull(), "clean").when(F.col("__c.cleaned").isNull(), "refused").otherwise("proposed")
    return found.select(*rows.columns, "__c.faults", "__c.cleaned", "__c.reason", outcome.alias("outcome"))


def enrichment_pass(people: DataFrame, offers: DataFrame, errors: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """What a pass proposes: ``fields`` (id, fields) to fill, ``conflicts`` (id, field, conflict), ``errors`` (id, error), ``tally`` (outcome, n).

    ``people``: (id, missing fields); ``offers``: (id, field, ord, source, value) of what sources say; ``errors``: (id, error) of
    requests that failed. A person with a failed request proposes nothing, as what is not known there might conflict; the others go on.
    Only missing fields are offered, and a budget of ``limit`` people is spent by id.
    """
    chosen = people.where(F.size("missing") > 0) if limit is None else enrichment_budget(people, limit)
    chosen = chosen.select("id", "missing")
    failed = errors.join(chosen.select("id"), "id").groupBy("id").agg(F.min("error").alias("error"))
    open_ = chosen.join(failed.select("id"), "id", "left_anti")
    wanted = spread(offers, "id").join(open_, "id").where(F.array_contains("missing", F.col("field"))).drop("missing")
    merged = merge_offers(wanted)
    fields = fields_map(merged)
    # each person's marks meet in one aggregate of numbers; no field or offer travels to the tally
    mark = lambda rows, **given: rows.select("id", *[F.coalesce(given.get(c, F.lit(0)).cast("long"), F.lit(0)).alias(c) for c in ("people", "error", "proposed", "clash")])
    marks = mark(chosen, people=F.lit(1)).unionByName(mark(failed, error=F.lit(1))).unionByName(mark(merged, proposed=F.col("agreed"), clash=~F.col("agreed")))
    each = marks.groupBy("id").agg(F.sum("people").alias("people"), *[F.max(c).alias(c) for c in ("error", "proposed", "clash")]).where("people > 0")
    outcome = F.when(F.col("error") > 0, "error").when(F.col("proposed") > 0, "proposed").when(F.col("clash") > 0, "conflict").otherwise("nothing found")
    told = each.groupBy(outcome.alias("outcome")).agg(F.sum("people").alias("n"))
    return {"fields": fields, "conflicts": merged.where("not agreed").select("id", "field", "conflict"), "errors": failed, "tally": told}

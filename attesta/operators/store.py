"""The proposal store as tables in, tables out: content ids, idempotent records, standing rejections, reads.

Tables are plain DataFrames (columns below); every transition returns the new table, so a writer swaps whole
snapshots and a repeated run changes nothing. Spark enforces no keys, so each writer drops repeats first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = ("dismissed", "muted", "superseded", "gone")
SETTLED = ("applied", "failed")
SUBJECT = ["subject_type", "subject_id"]
SCHEMAS = {
    "item": "fingerprint string, folder string, subject_type string, subject_id string, summary string, confidence double, payload string, producer string, state string, prior_state string, error string, created_at timestamp, last_seen_at timestamp, resolved_at timestamp",
    "dismissal": "fingerprint string, reason string, at timestamp",
    "mute": "subject_type string, subject_id string, reason string, at timestamp",
    "supersede": "fingerprint string, at timestamp",
    "refusal": "subject_type string, subject_id string, path string, reason string, at timestamp, stores array<struct<store: string, rows: bigint, score: double, title: string, url: string, error: string>>",
    "gone": "subject_type string, subject_id string, at timestamp",
    "run": "id string, job string, trigger string, started timestamp, finished timestamp, outcome string, counts map<string, bigint>, error string, seq bigint",
    "producer_run": "producer string, at string",
}


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, over Arrow batches."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def content_id(folder: Column, subject_type: Column, subject_id: Column, payload: Column, compose: bool = True) -> Column:
    """SHA-256 of a proposal. ``payload``: canonical JSON (keys sorted, no spaces, nulls written).

    ``compose`` is off only where texts are known to be composed.
    """
    text = F.concat_ws("\x1f", folder, subject_type, subject_id, payload)
    return F.sha2(nfc(text) if compose else text, 256)


def canonical_json(struct: Column) -> Column:
    """JSON of a struct whose fields are in alphabetical order."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def record(items: DataFrame, proposals: DataFrame, dismissals: DataFrame, mutes: DataFrame) -> DataFrame:
    """Items after a run's proposals (columns of items; ``last_seen_at`` is the run's time).

    A dismissed fingerprint or muted subject is not written; a known one has only last_seen_at touched.
    """
    bad = F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)
    checked = proposals.withColumn("confidence", F.when(bad, F.raise_error(F.lit("confidence lies outside 0 to 1"))).otherwise(F.col("confidence")))
    allowed = checked.join(dismissals.select("fingerprint"), "fingerprint", "left_anti").join(mutes.select(*SUBJECT), SUBJECT, "left_anti")
    every = items.withColumn("__new", F.lit(0)).unionByName(allowed.select(*items.columns).withColumn("__new", F.lit(1)))
    kept = [F.min_by(c, F.struct("__new", "created_at")).alias(c) for c in items.columns if c not in ("fingerprint", "last_seen_at")]
    return every.groupBy("fingerprint").agg(*kept, F.max("last_seen_at").alias("last_seen_at")).select(*items.columns)


def cleared_refusals(refusals: DataFrame, proposals: DataFrame, dismissals: DataFrame, mutes: DataFrame) -> DataFrame:
    """Refusals without those of subjects that now have a recorded proposal."""
    recorded = proposals.join(dismissals.select("fingerprint"), "fingerprint", "left_anti").join(mutes.select(*SUBJECT), SUBJECT, "left_anti")
    return refusals.join(recorded.select(*SUBJECT), SUBJECT, "left_anti")


def _marked(items: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return items.join(keys.select(*on).distinct().withColumn("__hit", F.lit(True)), on, "left")


def _moved(marked: DataFrame, state: Column | str, when: Column | None = None, **columns: Column) -> DataFrame:
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if when is None else when)
    state = state if isinstance(state, Column) else F.lit(state)
    return marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in {"state": state, **columns}.items()}).drop("__hit")


def set_state(items: DataFrame, fingerprints: DataFrame, state: str, at: Column, error: Column | None = None, prior: Column | None = None) -> DataFrame:
    """Items with a state set (seen, applied, failed, reverted); an unknown fingerprint raises."""
    unknown = fingerprints.select("fingerprint").join(items.select("fingerprint"), "fingerprint", "left_anti")
    count = unknown.agg(F.when(F.count(F.lit(1)) > 0, F.raise_error(F.lit("unknown fingerprint"))).alias("__checked"))  # one row
    more = {"error": error if error is not None else F.lit(None).cast("string")} if state in ("failed", "applied") else {}
    if prior is not None:
        more["prior_state"] = prior
    if state != "seen":
        more["resolved_at"] = at
    moved = _moved(_marked(items, fingerprints, ["fingerprint"]), state, **more)
    return moved.crossJoin(F.broadcast(count)).where("__checked is null").drop("__checked").select(*items.columns)


def dismiss(items: DataFrame, fingerprints: DataFrame, at: Column) -> DataFrame:
    return _moved(_marked(items, fingerprints, ["fingerprint"]), "dismissed", ~F.col("state").isin(*SETTLED), resolved_at=at).select(*items.columns)


def undismiss(items: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return _moved(_marked(items, fingerprints, ["fingerprint"]), "new", F.col("state") == "dismissed", resolved_at=F.lit(None).cast("timestamp")).select(*items.columns)


def mute(items: DataFrame, subjects: DataFrame, at: Column) -> DataFrame:
    return _moved(_marked(items, subjects, SUBJECT), "muted", ~F.col("state").isin(*SETTLED), resolved_at=at).select(*items.columns)


def unmute(items: DataFrame, subjects: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Muted items of the subjects become new, or dismissed where that still stands."""
    rows = _marked(items, subjects, SUBJECT).join(dismissals.select("fingerprint").distinct().withColumn("__stands", F.lit(True)), "fingerprint", "left")
    return _moved(rows, F.when(F.col("__stands"), "dismissed").otherwise("new"), F.col("state") == "muted").select(*items.columns)


def supersede(items: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return _moved(_marked(items, fingerprints, ["fingerprint"]), "superseded", ~F.col("state").isin(*SETTLED)).select(*items.columns)


def mark_gone(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """All items of the subjects are gone, whatever their state."""
    return _moved(_marked(items, subjects, SUBJECT), "gone").select(*items.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace those of the same keys; of rows that repeat a key, the latest by ``at``."""
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at")))).where("__n = 1").drop("__n")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))


def insert_once(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.select(*table.columns).dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def delete(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys), keys, "left_anti")


# Reads


def visible(items: DataFrame) -> DataFrame:
    return items.where(~F.col("state").isin(*HIDDEN))


def has(items: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Fingerprints with whether a visible item has them."""
    return _marked(fingerprints, visible(items), ["fingerprint"]).withColumn("has", F.coalesce("__hit", F.lit(False))).drop("__hit")


def clauses(folder: str | None = None, state: str | None = None, subject_types: Sequence[str] | None = None, exclude_states: Sequence[str] = ()) -> Column:
    """Conjunction of filters. Hidden states are left out unless asked for; an empty list of types selects nothing."""
    out = F.col("state") == state if state is not None else ~F.col("state").isin(*HIDDEN, *exclude_states)
    if folder is not None:
        out &= F.col("folder") == folder
    if subject_types is not None:
        out &= F.col("subject_type").isin(*subject_types) if subject_types else F.lit(False)
    return out


def item_page(items: DataFrame, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    rows = items.where(clauses(**filters)).orderBy("created_at", "fingerprint").offset(offset)
    return rows if limit is None else rows.limit(limit)


def item_count(items: DataFrame, **filters) -> DataFrame:
    return items.where(clauses(**filters)).agg(F.count(F.lit(1)).alias("n"))


def state_counts(items: DataFrame, folder: str | None = None, subject_types: Sequence[str] | None = None) -> DataFrame:
    return items.where(clauses(folder=folder, subject_types=subject_types)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def subject_counts(items: DataFrame, folder: str | None = None) -> DataFrame:
    """Items that wait for a decision, by subject type."""
    return items.where(clauses(folder=folder, exclude_states=("applied",))).groupBy("subject_type").agg(F.count(F.lit(1)).alias("n"))


def decoded_payload(items: DataFrame, schema: str | None = None) -> DataFrame:
    """Payload as a struct of ``schema``, or as a variant."""
    return items.withColumn("payload", F.from_json("payload", schema) if schema else F.try_parse_json(F.col("payload")))


def standing_mutes(mutes: DataFrame, gone: DataFrame, items: DataFrame) -> DataFrame:
    """Mutes of subjects that are not gone, each with its subject's latest item."""
    latest = items.groupBy(*SUBJECT).agg(F.max_by(F.struct("fingerprint", "summary", "folder"), F.struct("last_seen_at", "fingerprint")).alias("latest"))
    return mutes.join(gone.select(*SUBJECT), SUBJECT, "left_anti").join(latest, SUBJECT, "left").select(*mutes.columns, "latest.fingerprint", "latest.summary", "latest.folder")


def muted_subjects(mutes: DataFrame) -> DataFrame:
    return mutes.select(*SUBJECT)


def refusal_page(refusals: DataFrame, gone: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = refusals.join(gone.select(*SUBJECT), SUBJECT, "left_anti").orderBy("at", "subject_id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def refusal_count(refusals: DataFrame, gone: DataFrame) -> DataFrame:
    return refusals.join(gone.select(*SUBJECT), SUBJECT, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def subject_ids(items: DataFrame, mutes: DataFrame, refusals: DataFrame, subject_type: str) -> DataFrame:
    """Distinct subjects of a type in any of three tables."""
    one = lambda t: t.where(F.col("subject_type") == subject_type).select("subject_id")
    return one(items).union(one(mutes)).union(one(refusals)).distinct()


def add_missing_columns(table: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A table of an older shape with the columns it lacks, null or a default."""
    defaults = defaults or {}
    wanted = T._parse_datatype_string(schema)
    return table.select(*[F.col(f.name) if f.name in table.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def renamed_producers(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    """(producer, at) under new names; of two, the later valid instant, any valid one before a malformed."""
    new = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string, string>")
    renamed = runs.withColumn("producer", F.coalesce(F.try_element_at(new, F.col("producer")), F.col("producer")))
    return renamed.groupBy("producer").agg(F.max_by("at", F.struct(F.coalesce(F.col("at").try_cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col("at"))).alias("at"))

"""View queries: proposals, refusals, mutes and schedules as display rows, pages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.dates import local_minute
from attesta.functions.text import filled
from attesta.functions.urls import item_url
from attesta.operators.runs import inbox_of, waiting_counts

PAGE = 200
MATCH = "struct<title: string, url: string, studio: string, performers: array<string>, image: string, score: double>"
PAYLOADS = {
    "scene": f"match {MATCH}, creator string, stem string, competing array<string>, competing_store string, runners_up array<struct<title: string, score: double>>, identified_by string",
    "performer": "original string, cleaned string, faults array<string>",
    "performer-enrichment": "fields map<string, string>, sources array<string>",
    "tag": "name string, description string, source string",
    "tag-cluster": "members array<struct<id: string, name: string, scene_count: bigint>>, canonical string, undecided string",
    "tag-performer": "name string, scene_count bigint, matches array<struct<id: string, name: string, via: string>>, resolved string",
    "tag-unused": "name string, scene_count bigint, usage string",
}
KINDS = {"scene": "scenes", "performer": "performers", "performer-enrichment": "performers", "tag": "tags", "tag-cluster": "tags", "tag-performer": "tags", "tag-unused": "tags"}


def clauses(*parts: Column) -> Column:
    """Texts joined by '; ', null if all are null."""
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def disagreement(creator: Column, stem: Column, competing_store: Column) -> Column:
    """What speaks against an attribution: another name in the file, another store's pick."""
    return clauses(F.when(stem.isNotNull() & (stem != creator), F.concat(F.lit("the file names "), stem)), F.when(competing_store.isNotNull(), F.concat(F.lit("also found at "), competing_store)))


def carries_cover(match: Column) -> Column:
    return filled(match["image"]) != ""


def runner_up_view(losers: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, runners_up): what the "also considered" column shows of decisions.runners_up, the best first, each with its own address."""
    shown = F.struct("place", "title", F.col("value").alias("score"), "url")
    every = F.array_sort(F.collect_list(shown))
    return losers.groupBy(subject).agg(F.transform(every, lambda x: x.dropFields("place")).alias("runners_up"))


def rows_of(items: DataFrame, subject_type: str, base_url: str | None = None) -> DataFrame:
    """Display rows of one subject type, its payload decoded."""
    rows = items.where(F.col("subject_type") == subject_type).withColumn("p", F.from_json("payload", PAYLOADS[subject_type]))
    common = ["fingerprint", "subject_id", "summary", "state", "confidence", item_url(F.lit(base_url), KINDS[subject_type], F.col("subject_id")).alias("link")]
    waiting, done = F.col("state").isin("new", "seen"), F.col("state").isin("applied", "failed")
    undo = done & F.col("prior_state").isNotNull()
    p = F.col("p")
    own = {
        "scene": [
            p["creator"].alias("creator"), p["match"]["title"].alias("title"), p["match"]["studio"].alias("studio"), F.array_join(p["match"]["performers"], ", ").alias("performers"),
            carries_cover(p["match"]).alias("cover"), (F.size(F.coalesce(p["competing"], F.array().cast("array<string>"))) > 0).alias("contested"),
            disagreement(p["creator"], p["stem"], p["competing_store"]).alias("disagreement"), waiting.alias("actionable"), undo.alias("undoable"),
        ],
        "performer": [p["original"].alias("before"), p["cleaned"].alias("after"), F.array_join(p["faults"], ", ").alias("faults"), undo.alias("undoable")],
        "performer-enrichment": [F.map_keys(p["fields"]).alias("fields"), F.array_join(p["sources"], ", ").alias("sources"), undo.alias("undoable")],
        "tag": [p["name"].alias("name"), p["description"].alias("after"), p["source"].alias("source"), undo.alias("undoable")],
        "tag-cluster": [
            F.array_join(p["members"]["name"], ", ").alias("names"), F.aggregate(p["members"], F.lit(0).cast("long"), lambda n, m: n + F.coalesce(m["scene_count"], F.lit(0))).alias("total"),
            p["canonical"].alias("canonical"), p["undecided"].alias("undecided"), (waiting & p["canonical"].isNotNull()).alias("actionable"), F.lit(False).alias("undoable"),
        ],
        "tag-performer": [p["name"].alias("name"), p["scene_count"].alias("scene_count"), F.size(p["matches"]).alias("n_matches"), (waiting & p["resolved"].isNotNull()).alias("actionable"), undo.alias("undoable")],
        "tag-unused": [p["name"].alias("name"), p["scene_count"].alias("scene_count"), p["usage"].alias("usage"), waiting.alias("actionable"), F.lit(False).alias("undoable")],
    }
    return rows.select(*common, *own[subject_type])


def all_rows(items: DataFrame, base_url: str | None = None) -> DataFrame:
    """Rows of every type in one table, columns that a type lacks null."""
    out = None
    for kind in PAYLOADS:
        part = rows_of(items, kind, base_url).withColumn("subject_type", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def unused_groups_page(rows: DataFrame, page: int = 1, size: int = PAGE, order: tuple[str, ...] = ("no-scenes", "one-scene")) -> DataFrame:
    """A page of (usage, name, id) rows across groups in fixed order, each with its group's whole count.

    The page is a top-k of the ordered rows, so no task sorts the table.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("usage"))
    counts = rows.groupBy("usage").agg(F.count(F.lit(1)).alias("group_count"))
    cut = rows.withColumn("__place", place).orderBy("__place", "name", "id").offset(offset_for(page, size)).limit(size)
    return cut.join(counts, "usage").drop("__place")


def store_outcome(store: Column) -> Column:
    return F.when(store["error"].isNotNull(), "failed").when(F.coalesce(store["rows"], F.lit(0)) == 0, "empty").otherwise("answered")


def refusal_rows(refusals: DataFrame, base_url: str | None = None) -> DataFrame:
    """Refusals with what each store answered."""
    told = F.transform("stores", lambda s: F.struct(s["store"].alias("store"), store_outcome(s).alias("outcome"), s["rows"].alias("rows"), s["score"].alias("score"), s["title"].alias("title"), s["url"].alias("url")))
    return refusals.select("subject_type", "subject_id", item_url(F.lit(base_url), "scenes", F.col("subject_id")).alias("link"), "path", "reason", told.alias("stores"))


def mute_rows(mutes: DataFrame, zone: str = "UTC") -> DataFrame:
    return mutes.select("subject_type", "subject_id", "reason", local_minute(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), zone).alias("muted_at"), "summary", "folder")


def cadence(every: Column) -> Column:
    """An interval in its largest whole unit."""
    unit = lambda n, name: F.concat(F.lit("every "), (every / n).cast("long").cast("string"), F.lit(f" {name}"))
    return F.when(every % 86400 == 0, unit(86400, "d")).when(every % 3600 == 0, unit(3600, "h")).when(every % 60 == 0, unit(60, "min")).otherwise(unit(1, "s"))


def schedule_view(due_rows: DataFrame, now: Column) -> DataFrame:
    """Entries with their timing in words; the zone is written out only if entries have several."""
    from attesta.operators.schedule import next_occurrence

    zones = due_rows.agg((F.count_distinct("zone") > 1).alias("__many"))
    at = F.concat_ws(" ", F.concat(F.lit("at "), F.substring("at", 1, 5)), F.when(F.col("__many"), F.col("zone")))
    later = F.when(F.col("at").isNotNull(), next_occurrence(now, F.col("at"), F.col("zone"))).otherwise(F.timestamp_micros((F.unix_micros("last") + F.col("every") * 1_000_000).cast("long")))
    return due_rows.crossJoin(F.broadcast(zones)).select("producer", F.when(F.col("at").isNotNull(), at).otherwise(cadence(F.col("every"))).alias("timing"), "enabled", "last", later.alias("next"), "due", "reason")


def page_number(text: Column) -> Column:
    n = text.cast("string").try_cast("int")
    return F.when(n >= 1, n).otherwise(F.lit(1))


def total_pages(n: Column, size: int = PAGE) -> Column:
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("long")


def offset_for(page: int, size: int = PAGE) -> int:
    return (max(1, page) - 1) * size


def window_of(rows: DataFrame, order: list[str], page: int, size: int = PAGE) -> DataFrame:
    return rows.orderBy(*order).offset(offset_for(page, size)).limit(size)


def sidebar(items: DataFrame) -> DataFrame:
    """Per inbox: items that wait, and whether it has dismissed, applied or failed ones."""
    seen = items.withColumn("inbox", inbox_of(F.col("subject_type")))
    waits = ~F.col("state").isin("dismissed", "muted", "superseded", "gone", "applied")
    flags = seen.groupBy("inbox").agg(*[F.bool_or(F.col("state") == s).alias(f"has_{s}") for s in ("dismissed", "applied", "failed")])
    counts = waiting_counts(items.where(waits).groupBy("subject_type").agg(F.count(F.lit(1)).alias("n")))
    return counts.join(flags, "inbox", "left").select("inbox", F.col("n").alias("waiting"), *[F.coalesce(f"has_{s}", F.lit(False)).alias(f"has_{s}") for s in ("dismissed", "applied", "failed")])


def latest_view(log: DataFrame) -> DataFrame:
    """Each job's newest run from a log in any order."""
    first = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("started"), F.desc("seq")))
    return log.withColumn("__n", first).where("__n = 1").drop("__n")

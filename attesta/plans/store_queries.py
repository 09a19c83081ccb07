"""Queries over the proposal store, the run log, schedules, change sets and views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.operators import actions, changes, runs, schedule, selection, store, views as display
from attesta.plans import views
from attesta.plans.registry import query, quoted, shared_folder, table
from attesta.plans.views import ITEMS, MUTES, RUN_LOG, VISIBLE

_FIELDS = "fingerprint, folder, subject_type, subject_id, summary, state"


@query(f"WITH {ITEMS} SELECT {_FIELDS} FROM items WHERE {VISIBLE} AND folder = '2-HIGH' AND subject_type IN ('scene', 'tag') ORDER BY created_at, fingerprint LIMIT 200 OFFSET 20")
def item_page(spark, sf_dir):
    return store.item_page(views.items(spark, sf_dir), 200, 20, folder="2-HIGH", subject_types=("scene", "tag")).select(*_FIELDS.split(", "))


@query(f"WITH {ITEMS} SELECT count(*) AS n FROM items WHERE {VISIBLE} AND folder = '2-HIGH'")
def item_count(spark, sf_dir):
    return store.item_count(views.items(spark, sf_dir), folder="2-HIGH")


@query(f"WITH {ITEMS} SELECT state, count(*) AS n FROM items WHERE {VISIBLE} GROUP BY 1")
def state_counts(spark, sf_dir):
    return store.state_counts(views.items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT subject_type, count(*) AS n FROM items WHERE {VISIBLE} AND state <> 'applied' GROUP BY 1")
def subject_counts(spark, sf_dir):
    return store.subject_counts(views.items(spark, sf_dir))


@query(
    f"""WITH {ITEMS}, {MUTES} SELECT m.subject_type, m.subject_id, m.reason, i.fingerprint, i.summary, i.folder FROM mutes m
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_type, subject_id ORDER BY last_seen_at DESC, fingerprint DESC) AS n FROM items) WHERE n = 1) i
        ON i.subject_type = m.subject_type AND i.subject_id = m.subject_id WHERE CAST(m.subject_id AS BIGINT) % 7 <> 3"""
)
def visible_mutes(spark, sf_dir):
    muted = views.mutes(spark, sf_dir)
    gone = muted.where("cast(subject_id as bigint) % 7 = 3").select("subject_type", "subject_id")
    return store.standing_mutes(muted, gone, views.items(spark, sf_dir)).drop("at")


@query(f"WITH {ITEMS}, {MUTES} SELECT subject_id FROM items WHERE subject_type = 'tag' UNION SELECT subject_id FROM mutes WHERE subject_type = 'tag' UNION SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem")
def subject_union(spark, sf_dir):
    refused = table(spark, sf_dir, "lineitem").select(F.lit("tag").alias("subject_type"), F.col("l_suppkey").cast("string").alias("subject_id"))
    return store.subject_ids(views.items(spark, sf_dir), views.mutes(spark, sf_dir), refused, "tag")


@query(
    """SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderpriority, 'order', CAST(o_custkey AS VARCHAR),
        '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","who":null}')) AS fingerprint FROM orders"""
)
def content_id(spark, sf_dir):
    payload = store.canonical_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("who")))
    made = store.content_id(F.col("o_orderpriority"), F.lit("order"), F.col("o_custkey").cast("string"), payload)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("fingerprint"))


def _batch(spark, sf_dir):
    """Half of the items again, as a later run's proposals, and some new ones."""
    items = views.items(spark, sf_dir)
    later = F.lit("2030-01-01").cast("timestamp")
    again = items.where(F.substring("fingerprint", -1, 1) % 2 == 0).withColumns({"state": F.lit("new"), "summary": F.lit("again"), "created_at": later, "last_seen_at": later})
    fresh = again.where(F.substring("fingerprint", -1, 1) == "4").withColumn("fingerprint", F.concat(F.lit("new"), "fingerprint"))
    return items, again.unionByName(fresh)


_BATCH = f"""{ITEMS}, {MUTES}, batch AS (
    SELECT fingerprint, folder, subject_type, subject_id, 'again' AS summary, 'new' AS state FROM items WHERE CAST(right(fingerprint, 1) AS INTEGER) % 2 = 0
    UNION ALL SELECT 'new' || fingerprint, folder, subject_type, subject_id, 'again', 'new' FROM items WHERE right(fingerprint, 1) = '4'),
    allowed AS (SELECT * FROM batch WHERE fingerprint NOT IN (SELECT fingerprint FROM items WHERE state = 'dismissed')
        AND (subject_type, subject_id) NOT IN (SELECT subject_type, subject_id FROM mutes))"""


@query(
    f"""WITH {_BATCH} SELECT fingerprint, summary, state, fingerprint IN (SELECT fingerprint FROM allowed) AS touched FROM items
        UNION ALL SELECT fingerprint, summary, state, true FROM allowed WHERE fingerprint NOT IN (SELECT fingerprint FROM items)"""
)
def record_proposals(spark, sf_dir):
    items, batch = _batch(spark, sf_dir)
    after = store.record(items, batch, items.where("state = 'dismissed'"), views.mutes(spark, sf_dir))
    return after.select("fingerprint", "summary", "state", (F.col("last_seen_at") == F.lit("2030-01-01").cast("timestamp")).alias("touched"))


@query(
    f"""WITH {ITEMS}, {MUTES} SELECT fingerprint, CASE WHEN (subject_type, subject_id) IN (SELECT subject_type, subject_id FROM mutes) AND state NOT IN ('applied', 'failed') THEN 'muted' ELSE state END AS state FROM items"""
)
def mute_items(spark, sf_dir):
    return store.mute(views.items(spark, sf_dir), views.mutes(spark, sf_dir), F.current_timestamp()).select("fingerprint", "state")


@query(
    f"""WITH {ITEMS}, {MUTES} SELECT fingerprint, CASE WHEN (subject_type, subject_id) IN (SELECT subject_type, subject_id FROM mutes) AND state NOT IN ('applied', 'failed')
        THEN CASE WHEN right(fingerprint, 1) = '3' THEN 'dismissed' ELSE 'new' END ELSE state END AS state FROM items"""
)
def unmute_items(spark, sf_dir):
    items, subjects = views.items(spark, sf_dir), views.mutes(spark, sf_dir)
    muted = store.mute(items, subjects, F.current_timestamp())
    return store.unmute(muted, subjects, items.where(F.substring("fingerprint", -1, 1) == "3")).select("fingerprint", "state")


@query(
    f"""WITH {ITEMS} SELECT fingerprint, CASE WHEN right(subject_id, 1) = '7' THEN 'gone' WHEN right(fingerprint, 1) = '5' AND state <> 'applied' THEN 'superseded'
        WHEN right(fingerprint, 1) = '2' AND state <> 'applied' THEN 'dismissed' WHEN state = 'dismissed' THEN 'new' ELSE state END AS state
        FROM items"""
)
def state_moves(spark, sf_dir):
    items = views.items(spark, sf_dir)
    ending = lambda d, c="fingerprint": items.where(F.substring(c, -1, 1) == d)
    now = F.current_timestamp()
    back = store.undismiss(items, items)
    moved = store.supersede(store.dismiss(back, ending("2"), now), ending("5"))
    return store.mark_gone(moved, ending("7", "subject_id")).select("fingerprint", "state")


@query(f"WITH {ITEMS}, g AS (SELECT DISTINCT subject_type, subject_id FROM items WHERE CAST(subject_id AS BIGINT) % 5 = 0) SELECT state, count(*) AS n FROM (SELECT CASE WHEN (subject_type, subject_id) IN (SELECT subject_type, subject_id FROM g) THEN 'gone' ELSE state END AS state FROM items) GROUP BY 1")
def mark_gone(spark, sf_dir):
    items = views.items(spark, sf_dir)
    return store.mark_gone(items, items.where("cast(subject_id as bigint) % 5 = 0")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS} SELECT fingerprint, {VISIBLE} AS has FROM items")
def has_item(spark, sf_dir):
    items = views.items(spark, sf_dir)
    return store.has(items, items.select("fingerprint"))


@query(f"WITH {ITEMS}, b AS (SELECT fingerprint FROM items WHERE subject_type = 'tag' UNION ALL SELECT 'nobody') SELECT b.fingerprint, i.subject_type, CASE WHEN i.state IS NULL THEN 'unknown' WHEN NOT ({VISIBLE}) THEN 'not visible' WHEN i.state = 'applied' THEN 'already applied' ELSE 'ready' END AS outcome FROM b LEFT JOIN items i USING (fingerprint)")
def batch_outcomes(spark, sf_dir):
    items = views.items(spark, sf_dir)
    asked = items.where("subject_type = 'tag'").select("fingerprint").union(spark.createDataFrame([("nobody",)], "fingerprint string"))
    return actions.batch_outcomes(items, asked)


@query(f"WITH {ITEMS} SELECT fingerprint, CASE WHEN state = 'gone' THEN 'its subject is gone' WHEN state <> 'applied' THEN 'not applied' WHEN subject_type IN ('tag-cluster', 'tag-unused') THEN 'cannot be undone' ELSE 'no snapshot' END AS refused FROM items")
def undo_check(spark, sf_dir):
    items = views.items(spark, sf_dir)
    return actions.undo_check(items, items.select("fingerprint"))


@query(f"WITH {ITEMS}, {MUTES} SELECT fingerprint, subject_id, reason FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY created_at DESC, fingerprint) AS n FROM items) WHERE n = 1) JOIN mutes USING (subject_id)")
def refusal_upsert(spark, sf_dir):
    """The latest row of each subject replaces what was there: refusals kept one per subject."""
    items = views.items(spark, sf_dir).select("fingerprint", "subject_id", F.col("created_at").alias("at"))
    last = items.groupBy("subject_id").agg(F.min_by("fingerprint", F.struct(-F.unix_micros("at"), F.col("fingerprint"))).alias("fingerprint"), F.max("at").alias("at"))
    merged = store.upsert(items.select("subject_id", "fingerprint", "at").limit(0), last.select("subject_id", "fingerprint", "at"), ["subject_id"])
    return merged.join(views.mutes(spark, sf_dir).select("subject_id", "reason"), "subject_id").select("fingerprint", "subject_id", "reason")


# Runs


@query(f"WITH {RUN_LOG} SELECT job, id, outcome, seq FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY started DESC, seq DESC) AS n FROM run_log) WHERE n = 1")
def latest_run(spark, sf_dir):
    return runs.latest_per_job(views.run_log(spark, sf_dir)).select("job", "id", "outcome", "seq")


@query(f"WITH {RUN_LOG} SELECT id, job, seq FROM run_log ORDER BY started DESC, seq DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return runs.recent_runs(views.run_log(spark, sf_dir)).select("id", "job", "seq")


@query(f"WITH {RUN_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY finished IS NULL ORDER BY started DESC, seq DESC) AS n FROM run_log) SELECT id, finished IS NULL AS open FROM r WHERE finished IS NULL OR n <= 500")
def retention(spark, sf_dir):
    return runs.retain(views.run_log(spark, sf_dir)).select("id", F.col("finished").isNull().alias("open"))


@query(f"WITH {RUN_LOG} SELECT greatest(count(*) FILTER (WHERE finished IS NOT NULL) - 500, 0) AS n FROM run_log")
def evicted_runs(spark, sf_dir):
    return runs.evicted(views.run_log(spark, sf_dir))


@query(f"WITH {RUN_LOG} SELECT coalesce(CASE WHEN finished IS NULL AND id <> 'run9' THEN 'interrupted' ELSE outcome END, 'open') AS outcome, count(*) AS n FROM run_log GROUP BY 1")
def interrupted(spark, sf_dir):
    closed = runs.close_interrupted(views.run_log(spark, sf_dir), ["run9"], F.current_timestamp())
    return closed.groupBy(F.coalesce("outcome", F.lit("open")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_INBOX = "CASE WHEN subject_type = 'scene' THEN 'scenes' WHEN subject_type LIKE 'tag%' THEN 'tags' WHEN subject_type LIKE 'performer%' THEN 'performers' ELSE subject_type END"


@query(f"WITH {ITEMS} SELECT inbox, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_INBOX} AS inbox, 1 AS n FROM items WHERE {VISIBLE} AND state <> 'applied' UNION ALL SELECT unnest(['scenes', 'tags', 'performers']), 0) GROUP BY 1")
def rollup_waiting(spark, sf_dir):
    return runs.waiting_counts(store.subject_counts(views.items(spark, sf_dir)))


@query(
    f"""WITH {ITEMS}, s AS (SELECT {_INBOX} AS inbox, count(*) FILTER (WHERE {VISIBLE} AND state <> 'applied') AS waiting, bool_or(state = 'dismissed') AS has_dismissed,
        bool_or(state = 'applied') AS has_applied, bool_or(state = 'failed') AS has_failed FROM items GROUP BY 1) SELECT * FROM s"""
)
def sidebar(spark, sf_dir):
    return display.sidebar(views.items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT DISTINCT subject_type FROM items WHERE subject_type = 'other'")
def unmapped_types(spark, sf_dir):
    return runs.unmapped_types(views.items(spark, sf_dir))


_NOW = "TIMESTAMP '2024-01-31 12:00:00'"


@query(
    f"""WITH last AS (SELECT event_type AS producer, date_trunc('second', max(ts)) AS last FROM events WHERE event_type <> 'view' GROUP BY 1),
        e AS (SELECT * FROM (VALUES ('click', 3600.0, NULL, true), ('error', 172800.0, NULL, true), ('purchase', NULL, '09:30:00', true), ('signup', NULL, '23:30:00', true), ('view', 60.0, NULL, true), ('off', 60.0, NULL, false)) v(producer, every, clock, enabled))
        SELECT e.producer, CASE WHEN NOT enabled THEN 'disabled' WHEN last IS NULL THEN 'never run'
            WHEN clock IS NOT NULL THEN CASE WHEN last < (SELECT max(o) FROM (SELECT unnest([CAST('2024-01-30 ' || clock AS TIMESTAMP), CAST('2024-01-31 ' || clock AS TIMESTAMP)]) AS o) WHERE o <= {_NOW}) THEN 'due' ELSE 'not yet' END
            WHEN {_NOW} >= last + to_seconds(every) THEN 'due' ELSE 'not yet' END AS reason
        FROM e LEFT JOIN last USING (producer)"""
)
def due_producers(spark, sf_dir):
    declared = {"click": {"every": 3600}, "error": {"every": 172800}, "purchase": {"at": "09:30", "zone": "UTC"}, "signup": {"at": "23:30", "zone": "UTC"}, "view": {"every": 60}, "off": {"every": 60, "enabled": False}}
    entries = schedule.entries_table(spark, schedule.resolve_entries(declared, {}, "UTC"))
    iso = F.date_format(F.max("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    last = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("producer")).agg(iso.alias("at"))
    return schedule.due(entries, last, F.lit("2024-01-31 12:00:00").cast("timestamp")).select("producer", "reason")


@query()
def due_on_clock_changes(spark, sf_dir):
    """Previous and next occurrences of 01:30 in Lisbon around the clock changes of 2025."""
    days = table(spark, sf_dir, "region").select(F.explode(F.sequence(F.lit("2025-03-29 00:00:00").cast("timestamp"), F.lit("2025-03-31 00:00:00").cast("timestamp"), F.expr("interval 6 hours"))).alias("now"))
    at, zone = F.lit("01:30:00"), F.lit("Europe/Lisbon")
    return days.select("now", schedule.previous_occurrence(F.col("now"), at, zone).alias("before"), schedule.next_occurrence(F.col("now"), at, zone).alias("after")).distinct()


# Change sets


@query("SELECT DISTINCT l_orderkey AS scene_id, coalesce(CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 3 END, l_partkey) AS tag_id FROM lineitem")
def tag_rewrite(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_partkey").alias("tag_id"))
    merges = table(spark, sf_dir, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("loser"), (F.col("p_partkey") - 3).alias("survivor"))
    return changes.merge_entities(links, merges)


@query(
    """WITH r AS (SELECT o_custkey AS id, 'e' || (o_orderkey % 3) AS endpoint, CAST(o_orderkey % 4 AS VARCHAR) AS stash_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS side FROM orders)
        SELECT id, endpoint, first(stash_id ORDER BY side, stash_id) AS stash_id, count(DISTINCT stash_id) > 1 AS conflict FROM r GROUP BY 1, 2"""
)
def link_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("id"), F.concat(F.lit("e"), (F.col("o_orderkey") % 3).cast("string")).alias("endpoint"), (F.col("o_orderkey") % 4).cast("string").alias("stash_id"), "o_orderstatus")
    return changes.merge_links(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"))


def _scenes(spark, sf_dir):
    tags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("tag_ids"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(tags, orders["o_orderkey"] == tags["l_orderkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("details"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("studio_id"), F.array(F.col("o_custkey").cast("string")).alias("performer_ids"), "tag_ids",
    )


@query(
    """WITH t AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS tags FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'Title ' || o_orderkey ELSE o_orderpriority END AS title,
            CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 's' || (o_custkey % 9) END AS studio_id,
            array_to_string(list_filter(list_concat(tags, ['new']), lambda x: x <> tags[1]), ',') AS tag_ids, o_custkey || ',p1' AS performer_ids,
            array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'title' END, 'details', 'date', CASE WHEN o_orderkey % 2 = 0 THEN 'studio' END], lambda x: x IS NOT NULL), ',') AS skipped
        FROM orders JOIN t ON t.id = o_orderkey"""
)
def scene_changeset(spark, sf_dir):
    scenes = _scenes(spark, sf_dir)
    key = F.col("id")
    matches = scenes.select(
        "id", F.when(key % 3 > 0, F.concat(F.lit("<b>Title</b> "), key.cast("string"))).alias("title"), F.lit("").alias("details"), F.lit(None).cast("string").alias("date"),
        F.concat(F.lit("s"), (F.element_at("performer_ids", 1).cast("long") % 9).cast("string")).alias("studio_id"), F.array(F.lit("p1")).alias("performer_ids"),
        F.array(F.lit("new")).alias("tag_ids"), F.slice("tag_ids", 1, 1).alias("drop_tag_ids"),
    )
    rows = changes.scene_changes(scenes, matches)
    return rows.select("id", "title", "studio_id", *[F.array_join(c, ",").alias(c) for c in ("tag_ids", "performer_ids", "skipped")])


@query(
    """WITH h AS (SELECT DISTINCT l_orderkey AS id, l_partkey FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY id) AS n FROM h)
        SELECT CAST(l_partkey AS VARCHAR) AS tag_id, n.id, CAST(floor((n - 1) / 200) AS BIGINT) AS chunk, CAST(l_partkey % 7 AS VARCHAR) <> CAST(o_custkey AS VARCHAR) AS attached
        FROM n JOIN orders ON o_orderkey = n.id"""
)
def reconcile_labels(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("tag_id"), (F.col("p_partkey") % 7).cast("string").alias("performer_id"))
    return changes.reconcile(_scenes(spark, sf_dir), pairs).select("tag_id", "id", "chunk", "attached")


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE upper(c_name) END AS new, c_name AS prior, CASE WHEN c_custkey % 3 = 0 THEN 'changed meanwhile' END AS refused
        FROM customer"""
)
def compare_and_set(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    wanted = rows.select("id", F.upper("name").alias("value"), F.when(F.col("id") % 3 == 0, "else").otherwise(F.col("name")).alias("expected"))
    return changes.compare_and_set(rows, wanted, "name")


@query(
    """WITH w AS (SELECT o_custkey AS id, field FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES ('a'), ('b')) v(field))
        SELECT id, field, CASE WHEN id % 4 = 0 THEN CASE WHEN field = 'a' THEN 'old' ELSE '' END ELSE 'v' END AS value, id % 4 = 0 AS refused FROM w"""
)
def fill_blanks(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    every = ids.select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field"))
    current = every.withColumn("value", F.when((F.col("id") % 4 == 0) & (F.col("field") == "a"), "old").otherwise(""))
    return changes.fill_blanks(current, every.withColumn("value", F.lit("v"))).select("id", "field", "value", "refused")


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_partkey % 5 = 0 AND p_size % 2 = 0)")
def guarded_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("scene_count"))
    doomed = rows.where("id % 5 = 0").select("id", F.when(F.col("scene_count") % 2 == 0, F.col("scene_count")).otherwise(F.lit(-1)).alias("expected"))
    return changes.guarded_delete(rows, doomed).select("id")


@query("SELECT upper(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1")
def find_or_create(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entities = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).withColumn("aliases", F.array().cast("array<string>"))
    names = part.select(F.upper("p_name").alias("name"), F.lit(None).cast("string").alias("stored_id")).distinct()
    return changes.find_or_create(names, entities).select("name", F.col("id").cast("long").alias("id"))


@query("SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN '2010-' || CASE WHEN o_custkey % 3 > 0 THEN '2015' ELSE '' END END AS career FROM orders")
def career_spans(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return ids.select("id", changes.career_length(F.when(F.col("id") % 2 == 0, 2010), F.when(F.col("id") % 3 > 0, 2015)).alias("career"))


# Views


@query(
    """WITH s AS (SELECT name, CASE scene_count WHEN 1 THEN 'one-scene' END AS usage FROM (SELECT p_name || ' ' || p_brand AS name, least(count(*), 2) AS scene_count FROM part GROUP BY 1)),
        u AS (SELECT name, md5(name) AS id, usage FROM s WHERE usage IS NOT NULL)
        SELECT name, id, usage, (SELECT count(*) FROM u) AS group_count FROM u ORDER BY name, id LIMIT 50 OFFSET 50"""
)
def unused_groups_page(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).count().where("count = 1")
    rows = names.select("name", F.md5("name").alias("id"), F.lit("one-scene").alias("usage"))
    return display.unused_groups_page(rows, page=2, size=50)


@query(
    """SELECT l_orderkey AS subject_id, 'https://x/scenes/' || l_orderkey AS link, string_agg(CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_returnflag = 'N' THEN 'empty' ELSE 'answered' END, ',' ORDER BY l_suppkey, l_returnflag) AS outcomes
        FROM lineitem GROUP BY 1"""
)
def refusal_view(spark, sf_dir):
    entry = F.struct(
        F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_suppkey").cast("string").alias("store"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).cast("long").alias("rows"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url"), F.when(F.col("l_returnflag") == "A", "down").alias("error"),
    )
    refusals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("subject_id")).agg(F.array_sort(F.collect_list(entry)).alias("stores"))
    rows = refusals.withColumns({"subject_type": F.lit("scene"), "path": F.lit(None).cast("string"), "reason": F.lit("none")})
    return display.refusal_rows(rows, "https://x/").select("subject_id", "link", F.array_join("stores.outcome", ",").alias("outcomes"))


@query("SELECT o_orderkey, greatest(coalesce(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey % 9 - 2 AS VARCHAR) END AS INTEGER), 1), 1) AS page, greatest(CAST(ceil(o_orderkey / 200.0) AS BIGINT), 1) AS pages FROM orders")
def paging(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise((F.col("o_orderkey") % 9 - 2).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", display.page_number(text).alias("page"), display.total_pages(F.col("o_orderkey")).alias("pages"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'https://h/tags/' || p_partkey END AS link, 'https://h' AS base FROM part")
def entity_urls(spark, sf_dir):
    base = F.when(F.col("p_partkey") % 5 > 0, "https://h//").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", urls.item_url(base, "tags", F.col("p_partkey")).alias("link"), urls.base_url(F.lit("https://h/graphql/")).alias("base"))


@query(f"WITH {ITEMS} SELECT subject_type, count(*) AS n FROM items WHERE subject_type <> 'other' GROUP BY 1")
def display_rows(spark, sf_dir):
    """Rows of all types in one table, counted by type."""
    return display.all_rows(views.items(spark, sf_dir), "https://x").groupBy("subject_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderkey AS id, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 200) AS BIGINT) AS chunk FROM orders")
def chunked(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"))
    return selection.chunks(rows, "id", within="o_orderpriority").select("o_orderpriority", "id", "chunk")


@query("SELECT event_type AS folder, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def streamed_proposals(spark, sf_dir):
    """Events recorded as proposals by a stream that ends with what it has; replays change nothing."""
    from attesta.streaming.proposals import items_table, proposals_of, start_recording

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    items = items_table(spark, f"{folder}/items", 64)
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    none = [spark.createDataFrame([], store.SCHEMAS[name]) for name in ("dismissal", "mute")]
    start_recording(proposals_of(source), items, *none, f"{folder}/checkpoint").awaitTermination()
    return items.read().groupBy("folder").agg(F.count(F.lit(1)).alias("n"))

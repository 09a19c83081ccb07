"""Queries over writes: changes routed from approved proposals, undo by fields, recording in buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta.operators import outgoing, store
from attesta.plans.registry import query, shared_folder, table
from attesta.session import spread
from attesta.streaming.proposals import items_table, proposals_of


def _items(rows, subject_type: str, subject, payload, state: str = "new"):
    """Item rows with what routing reads; the content id is the subject's type and id."""
    made = rows.select(
        F.concat(F.lit(f"{subject_type}/"), subject.cast("string")).alias("fingerprint"), F.lit(subject_type).alias("subject_type"), subject.cast("string").alias("subject_id"), payload.alias("payload"), F.lit(state).alias("state")
    )
    return store.add_missing_columns(made, store.SCHEMAS["item"])


def _uses(spark, sf_dir):
    """Parts with the number of line items that name them."""
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"))
    return table(spark, sf_dir, "part").join(uses, "p_partkey", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


_USES = "uses AS (SELECT p_partkey, p_name, p_brand, p_size, p_type, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS uses FROM part)"


@query(
    f"""WITH {_USES},
    clusters AS (
        SELECT p_name AS key, list('{{"id":"' || p_partkey || '"}}' ORDER BY CAST(p_partkey AS VARCHAR)) AS members, count(*) AS n,
               min(CAST(p_partkey AS VARCHAR)) FILTER (WHERE uses = most) AS first_id, count(*) FILTER (WHERE uses = most) AS best
        FROM (SELECT *, max(uses) OVER (PARTITION BY p_name) AS most FROM uses) GROUP BY 1)
    SELECT 'tag-unused/' || p_partkey AS change_id, 'tag-delete' AS kind, CAST(p_partkey AS VARCHAR) AS subject_id, '{{"scene_count":{{"expected":' || uses || '}}}}' AS edits, NULL AS refused FROM uses
    UNION ALL SELECT 'performer/' || s_suppkey, 'performer', CAST(s_suppkey AS VARCHAR), '{{"details":{{"set":"' || replace(s_name, '#', ' ') || '","expected":"' || s_name || '"}}}}', NULL FROM supplier
    UNION ALL SELECT 'performer-enrichment/' || c_custkey, 'performer', CAST(c_custkey AS VARCHAR),
        '{{"country":{{"fill":"' || c_mktsegment || '"}},"height_cm":{{"fill":' || c_nationkey || '}},"alias_list":{{"fill":["' || c_name || '"]}}}}', NULL FROM customer
    UNION ALL SELECT 'tag/' || n_nationkey, 'tag', CAST(n_nationkey AS VARCHAR), '{{"description":{{"fill":"' || n_name || '"}}}}', NULL FROM nation
    UNION ALL SELECT 'tag-cluster/' || key, 'tag-merge', CASE WHEN best = 1 THEN first_id ELSE key END,
        CASE WHEN best = 1 THEN '{{"sources":{{"set":[' || array_to_string([string_split(m, '"')[4] FOR m IN members IF string_split(m, '"')[4] <> first_id].list_transform(lambda x: '"' || x || '"'), ',') || ']}}}}' END,
        CASE WHEN best > 1 THEN 'no agreed surviving spelling: ' || best || ' are used as often' END FROM clusters
    UNION ALL SELECT 'event/' || event_type, 'none', event_type, NULL, 'no write for its type' FROM events GROUP BY event_type"""
)
def routed_changes(spark, sf_dir):
    """Approved proposals of five types as the changes that the sink writes; an undecided cluster and an unknown type are refused."""
    parts = _uses(spark, sf_dir)
    number = F.col("p_partkey").cast("string")
    best = parts.groupBy("p_name").agg(F.max("uses").alias("most"))
    clusters = parts.join(best, "p_name").groupBy("p_name").agg(
        F.array_sort(F.collect_list(F.struct(number.alias("id")))).alias("members"),
        F.count(F.when(F.col("uses") == F.col("most"), 1)).alias("best"),
        F.min(F.when(F.col("uses") == F.col("most"), number)).alias("first"),
    )
    canonical = F.when(F.col("best") == 1, F.struct(F.col("first").alias("id")))
    undecided = F.when(F.col("best") > 1, F.concat(F.col("best").cast("string"), F.lit(" are used as often")))
    people = table(spark, sf_dir, "customer")
    fields = F.create_map(F.lit("alias_list"), F.to_json(F.array("c_name")), F.lit("country"), F.col("c_mktsegment"), F.lit("height_cm"), F.col("c_nationkey").cast("string"))
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    kinds = table(spark, sf_dir, "events").groupBy("event_type").count()
    every = [
        _items(parts, "tag-unused", F.col("p_partkey"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("uses").alias("scene_count")))),
        _items(suppliers, "performer", F.col("s_suppkey"), F.to_json(F.struct(F.translate("s_name", "#", " ").alias("cleaned"), F.col("s_name").alias("original")))),
        _items(people, "performer-enrichment", F.col("c_custkey"), F.to_json(F.struct(fields.alias("fields")))),
        _items(nations, "tag", F.col("n_nationkey"), F.to_json(F.struct(F.col("n_name").alias("description"), F.lit("nations").alias("source")))),
        _items(clusters, "tag-cluster", F.col("p_name"), F.to_json(F.struct(canonical.alias("canonical"), "members", undecided.alias("undecided")))),
        _items(kinds, "event", F.col("event_type"), F.lit("{}")),
    ]
    items = every[0]
    for more in every[1:]:
        items = items.unionByName(more)
    return outgoing.routed(items).select("change_id", "kind", "subject_id", "edits", "refused")


@query(
    """WITH m AS (
        SELECT l_orderkey AS id, list_sort(list(DISTINCT '"' || l_suppkey || '"')) AS people, list_sort(list(DISTINCT '"' || l_returnflag || l_linestatus || '"')) AS tags FROM lineitem GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS subject_id,
           '{"title":{"set":"' || o_orderpriority || '"},"date":{"set":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}'
           || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"studio_id":{"claim":"' || o_orderstatus || '"}' END
           || CASE WHEN people IS NULL THEN '' ELSE ',"performer_ids":{"add":[' || array_to_string(people, ',') || ']}' END
           || ',"tag_ids":{' || CASE WHEN tags IS NULL THEN '' ELSE '"add":[' || array_to_string(tags, ',') || '],' END || '"drop":["marker"]}'
           || ',"organized":{"set":true}}' AS edits
    FROM orders LEFT JOIN m ON id = o_orderkey"""
)
def scene_writes(spark, sf_dir):
    """Resolved matches as edits of scenes: scalars set, the studio claimed if there is none, people and tags added, the marker dropped."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("performer_ids"), F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("tag_ids")
    )
    orders = table(spark, sf_dir, "orders")
    studio = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    matches = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), studio.alias("studio_id"),
        "performer_ids", "tag_ids", F.array(F.lit("marker")).alias("drop_tag_ids"),
    )
    return outgoing.scene_edits(matches)


@query(
    """WITH o AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, list(DISTINCT CAST(l_suppkey AS VARCHAR)) AS people, list(DISTINCT l_returnflag || l_linestatus) AS tags FROM lineitem GROUP BY 1),
    s AS (SELECT id, people, unnest(tags) AS tag_id FROM o),
    p AS (SELECT l_returnflag || l_linestatus AS tag_id, CAST(min(l_suppkey) AS VARCHAR) AS performer_id FROM lineitem GROUP BY 1),
    n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY s.tag_id ORDER BY id) - 1) / 200) AS BIGINT) AS chunk FROM s JOIN p USING (tag_id))
    SELECT tag_id AS fingerprint, chunk, performer_id, count(*) AS untagged, count(*) FILTER (WHERE NOT list_contains(people, performer_id)) AS attached,
        '{"ids":[' || string_agg('"' || id || '"', ',' ORDER BY id) || '],"performer_ids":{"ids":["' || performer_id || '"],"mode":"ADD"},"tag_ids":{"ids":["' || tag_id || '"],"mode":"REMOVE"}}' AS edits
    FROM n GROUP BY tag_id, chunk, performer_id"""
)
def reconciliation_writes(spark, sf_dir):
    """A tag that is a person: a bulk write for each 200 of its scenes, and what its undo has to know."""
    lines = table(spark, sf_dir, "lineitem")
    tag, who = F.concat("l_returnflag", "l_linestatus"), F.col("l_suppkey").cast("string")
    scenes = spread(lines.select(F.col("l_orderkey").cast("string").alias("id"), who.alias("who"), tag.alias("tag")), "id").groupBy("id").agg(F.collect_set("who").alias("performer_ids"), F.collect_set("tag").alias("tag_ids"))
    pairs = lines.groupBy(tag.alias("tag_id")).agg(F.min("l_suppkey").cast("string").alias("performer_id")).withColumn("fingerprint", F.col("tag_id"))
    rows = outgoing.reconciliation_edits(scenes, pairs)
    return rows.select("fingerprint", "chunk", "performer_id", F.size("untagged").cast("long").alias("untagged"), F.size("attached").cast("long").alias("attached"), "edits")


_FIELDS = {"flag": "l_returnflag", "status": "l_linestatus", "month": "strftime(l_shipdate, '%m')"}
_UNDO = f"""lines AS (
    SELECT l_partkey, {", ".join(f'''min({x}) AS {f}_prior, max({x}) AS {f}_written, first({x} ORDER BY l_orderkey, l_linenumber, {x}) AS {f}_now''' for f, x in _FIELDS.items())} FROM lineitem GROUP BY 1),
    fields AS ({" UNION ALL ".join(f"""SELECT 'fp' || p_partkey AS fingerprint, CAST(p_partkey AS VARCHAR) AS subject_id, p_type = 'ECONOMY' AS gone, '{f}' AS field,
        '"' || {f}_prior || '"' AS prior, '"' || {f}_written || '"' AS written, CASE WHEN p_type <> 'ECONOMY' THEN '"' || {f}_now || '"' END AS present FROM part JOIN lines ON l_partkey = p_partkey""" for f in _FIELDS)}),
    judged AS (
    SELECT *, CASE WHEN gone THEN 'gone' WHEN present = prior THEN 'restored' WHEN present = written THEN 'restore' ELSE 'changed meanwhile' END AS verdict FROM fields WHERE prior <> written)"""


def _undo(spark, sf_dir):
    """Parts as scenes whose fields were written: before, the least of a part's line items; written, the greatest; now, those of its first line."""
    month = F.date_format("l_shipdate", "MM")
    of = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "month": month}
    lines = table(spark, sf_dir, "lineitem")
    states = lambda pick: F.to_json(F.struct(*[pick(x).alias(f) for f, x in of.items()]))
    first = lambda x: F.min_by(x, F.struct("l_orderkey", "l_linenumber", x))
    found = lines.groupBy("l_partkey").agg(states(F.min).alias("prior"), states(F.max).alias("written"), states(first).alias("now"))
    parts = table(spark, sf_dir, "part").join(found, F.col("l_partkey") == F.col("p_partkey"))
    own = parts.select(F.concat(F.lit("fp"), F.col("p_partkey").cast("string")).alias("fingerprint"), F.lit("scene").alias("subject_type"), F.col("p_partkey").cast("string").alias("subject_id"), "p_type", "prior", "written", "now")
    items = store.add_missing_columns(own.select("fingerprint", "subject_type", "subject_id", F.lit("applied").alias("state"), F.col("prior").alias("prior_state")), store.SCHEMAS["item"])
    present = own.where("p_type <> 'ECONOMY'").select("subject_type", "subject_id", F.col("now").alias("state"))
    return outgoing.undo_fields(items, own.select("fingerprint", "written"), present)


@query(f"WITH {_UNDO} SELECT fingerprint, subject_id, field, prior, written, present, verdict FROM judged")
def undo_fields(spark, sf_dir):
    """Three-way comparison of what was there, what was written and what is there now."""
    return _undo(spark, sf_dir).drop("subject_type")


@query(
    f"""WITH {_UNDO}, bad AS (SELECT DISTINCT fingerprint FROM judged WHERE verdict IN ('gone', 'changed meanwhile')),
    edits AS (SELECT fingerprint, subject_id, '"' || field || '":{{"set":' || prior || ',"expected":' || written || '}}' AS edit FROM judged WHERE verdict = 'restore' AND fingerprint NOT IN (SELECT fingerprint FROM bad))
    SELECT 'undo:' || fingerprint AS change_id, 'scene' AS kind, subject_id, '{{' || string_agg(edit, ',' ORDER BY edit) || '}}' AS edits FROM edits GROUP BY ALL"""
)
def undo_writes(spark, sf_dir):
    """The changes that put fields back, of proposals none of whose fields changed meanwhile."""
    return outgoing.undo_changes(_undo(spark, sf_dir)).drop("fingerprint")


@query(
    """WITH e AS (SELECT *, sha256(concat_ws(chr(31), event_type, 'tag', CAST(user_id AS VARCHAR), '{"kind":"' || event_type || '","user":' || user_id || '}')) AS fingerprint FROM events)
    SELECT fingerprint, event_type AS folder, CAST(user_id AS VARCHAR) AS subject_id, CAST(epoch_us(min(ts)) AS BIGINT) AS created, CAST(epoch_us(max(ts)) AS BIGINT) AS seen,
           CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99.9) THEN 'muted' ELSE 'new' END AS state
    FROM e GROUP BY ALL"""
)
def bucketed_items(spark, sf_dir):
    """Events recorded in a bucketed table in two batches, the second one twice, then subjects muted in the buckets that hold them."""
    from attesta.sources.buckets import merge_by_subject

    events = table(spark, sf_dir, "events")
    every = proposals_of(events).withColumn("late", (F.col("created_at") >= "2024-01-15").cast("int"))
    items = items_table(spark, f"{shared_folder(spark)}/items-{uuid.uuid4().hex}", 64)
    none = [spark.createDataFrame([], store.SCHEMAS[name]) for name in ("dismissal", "mute")]
    for k, late in enumerate((0, 1, 1)):
        batch = every.where(F.col("late") == late).drop("late")
        items.merge(batch, lambda rows, new: store.record(rows, new, *none), ("events", min(k, 1)))
    loud = events.where("event_type = 'error' and value > 99.9").select(F.lit("tag").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"))
    merge_by_subject(items, loud, lambda rows, subjects: store.mute(rows, subjects, F.lit("2024-06-01").cast("timestamp")))
    micro = lambda c: F.unix_micros(F.col(c))
    return items.read().select("fingerprint", "folder", "subject_id", micro("created_at").alias("created"), micro("last_seen_at").alias("seen"), "state")

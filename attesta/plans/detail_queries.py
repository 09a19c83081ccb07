"""Queries over the smaller operators: guards, keys, mutes, snapshots, renames and display texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import substitutions, text, urls
from attesta.functions.vocab import CONTAINER_NAMES
from attesta.operators import adapters, attribution, changes, claims, runs, selection, store, views as display
from attesta.plans import views
from attesta.plans.registry import key_sql, normal_sql, query, quoted, table
from attesta.plans.views import FILES, ITEMS, MUTES, VISIBLE, files
from attesta.sources import tables


@query(f"SELECT c_custkey, {key_sql('c_name')} <> '' AND {key_sql('c_name')} = {key_sql('other')} AS same FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN upper(replace(c_name, '#', ' ')) WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS other FROM customer)")
def same_names(spark, sf_dir):
    key = F.col("c_custkey")
    other = F.when(key % 3 == 0, F.upper(F.replace("c_name", F.lit("#"), F.lit(" ")))).when(key % 3 == 1, F.col("c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", attribution.same_name(F.col("c_name"), other).alias("same"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 1) || '|' || p_brand ELSE '' END AS names,
        CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 1) ELSE NULL END AS one FROM part"""
)
def filename_names(spark, sf_dir):
    """Names that file names offer: none without a dash, one before it, two before two, none that is a date."""
    first, kind = F.split("p_name", " ")[0], F.col("p_partkey") % 4
    name = F.when(kind == 0, F.concat("p_name", F.lit(".mp4"))).when(kind == 1, F.concat(first, F.lit(" - title.mkv")))
    name = name.when(kind == 2, F.concat(first, F.lit(" - "), "p_brand", F.lit(" - title.mp4"))).otherwise(F.lit("2023-09-11 - title.mp4"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", F.array_join(attribution.filename_candidates(F.col("name")), "|").alias("names"), attribution.filename_candidate(F.col("name")).alias("one"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) END AS featured FROM part"""
)
def featured_names(spark, sf_dir):
    """A name after a feat marker counts if it also leads the text."""
    first, kind = F.split("p_name", " ")[0], F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat(first, F.lit(" walks feat. "), first)).when(kind == 1, F.concat(F.lit("Someone walks feat. "), first)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", attribution.featured_name(name).alias("featured"))


_SEGMENTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '^[^?#]*?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"


@query(
    f"""SELECT page_id, coalesce(s[2], '') AS by_url, 'Owner ' || page_id AS by_field, starts_with({key_sql("coalesce(s[2], '')")}, 'no') AS features
        FROM (SELECT page_id, {_SEGMENTS} AS s FROM pages)"""
)
def result_owners(spark, sf_dir):
    by_url = adapters.Adapter("a", owner_source="url_segment", owner_segment=1)
    by_field = adapters.Adapter("b", owner_source="result_field", owner_field=("owner", "name"))
    name = F.concat(F.lit("<b>Owner</b> "), F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.struct(F.struct(name.alias("name")).alias("owner")).alias("result"))
    owner = by_url.owner_of(F.col("url"))
    return rows.select(
        "page_id", owner.alias("by_url"), by_field.owner_of(F.col("url"), F.col("result")).alias("by_field"),
        by_url.features_artist(F.col("url"), F.lit(""), owner, F.lit("no")).alias("features"),
    )


@query("SELECT c_custkey, lower(trim(regexp_replace(c_name || '   ' || coalesce(c_mktsegment, ''), '\\s+', ' ', 'g'))) AS both, lower(c_mktsegment) AS omitted FROM customer")
def search_queries(spark, sf_dir):
    both, omits = adapters.Adapter("a"), adapters.Adapter("b", search_omits_seed=True)
    title = F.concat(F.lit("  "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", both.search_query(F.col("c_name"), title).alias("both"), omits.search_query(F.col("c_name"), title).alias("omitted"))


@query("SELECT p_partkey, replace(lower(trim(regexp_replace(p_name || '  Straße ' || p_brand, '\\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM part")
def query_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.query_key(F.concat("p_name", F.lit("  Straße "), "p_brand")).alias("key"))


@query(f"SELECT o_orderkey, lower(n) AS container, lower(n) IN ({quoted(CONTAINER_NAMES)}) AS is_container FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Videos' WHEN 1 THEN o_orderpriority ELSE 'downloads' END AS n FROM orders)")
def container_folders(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, "Videos (old) [x]").when(key % 3 == 1, F.col("o_orderpriority")).otherwise("downloads 1080p")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.container_name(name).alias("container"), text.is_container(name).alias("is_container"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(q, '&', 'and') WHEN 1 THEN replace(q, ' and ', ' & ') ELSE '' END AS variants FROM (
        SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN ' & ' WHEN 1 THEN ' and ' ELSE 'and' END) AS q FROM part)"""
)
def ampersand_spellings(spark, sf_dir):
    key = F.col("p_partkey") % 3
    query_text = F.replace("p_name", F.lit(" "), F.when(key == 0, " & ").when(key == 1, " and ").otherwise("and"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(substitutions.ampersand_variants(query_text), "|").alias("variants"))


@query("SELECT * FROM (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'MD5' ELSE 'OSHASH' END AS algorithm, CAST(l_partkey AS VARCHAR) AS hash FROM lineitem)")
def checked_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "MD5").otherwise("OSHASH").alias("algorithm"), F.col("l_partkey").cast("string").alias("hash"))
    return claims.checked_fingerprints(rows)


@query("SELECT s_suppkey, 'https://h' || (s_suppkey % 3) AS base, CASE WHEN s_suppkey % 3 > 0 THEN 'e' || s_suppkey END AS stash_id FROM supplier")
def linked_sources(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("https://h"), (key % 3).cast("string"), F.lit("/graphql")).alias("e"), F.when(key % 3 > 0, F.concat(F.lit("e"), key.cast("string"))).otherwise("").alias("i"))
    link = changes.with_link(F.array().cast("array<struct<endpoint: string, stash_id: string>>"), changes.catalogue_link(F.col("e"), F.col("i")))
    return rows.select("s_suppkey", urls.base_url(F.col("e")).alias("base"), F.try_element_at(link, F.lit(1))["stash_id"].alias("stash_id"))


# Store, mutes and selection


@query(f"WITH {MUTES} SELECT subject_type, subject_id FROM mutes WHERE reason IS DISTINCT FROM (SELECT min(reason) FROM mutes)")
def released_mutes(spark, sf_dir):
    muted = views.mutes(spark, sf_dir)
    retired = muted.agg(F.min("reason").alias("retired"))
    kept = muted.crossJoin(F.broadcast(retired))  # one row
    return store.muted_subjects(selection.release_mutes(kept.withColumn("reason", F.when(F.col("reason").eqNullSafe(F.col("retired")), "retired").otherwise(F.col("reason"))), "retired"))


@query(f"WITH {ITEMS}, {MUTES} SELECT DISTINCT 'muted' AS kind, subject_id FROM mutes WHERE subject_type = 'tag' UNION ALL SELECT DISTINCT 'proposed', subject_id FROM items WHERE subject_type = 'tag' AND folder = '2-HIGH' AND {VISIBLE}")
def narrowed_subjects(spark, sf_dir):
    muted, proposed = selection.narrowings(views.mutes(spark, sf_dir), views.items(spark, sf_dir), "tag", "2-HIGH")
    return muted.select(F.lit("muted").alias("kind"), "subject_id").unionByName(proposed.select(F.lit("proposed").alias("kind"), "subject_id"))


@query(f"WITH {ITEMS} SELECT fingerprint, CASE WHEN CAST(substr(fingerprint, 3) AS BIGINT) % 4 = 0 AND state NOT IN ('applied', 'failed') THEN 'superseded' ELSE state END AS state FROM items")
def superseded_items(spark, sf_dir):
    items = views.items(spark, sf_dir)
    return store.supersede(items, items.where(F.substring("fingerprint", 3, 20).cast("long") % 4 == 0).select("fingerprint")).select("fingerprint", "state")


@query("SELECT n_nationkey, n_name, 'none' AS note, CAST(NULL AS BIGINT) AS seen FROM nation")
def widened_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey")
    return store.add_missing_columns(rows, "n_nationkey long, n_name string, note string, seen long", {"note": "none"})


_TICKS = """ticks AS (SELECT CASE WHEN o_custkey % 50 = 7 THEN 'old' || (o_orderkey % 3) ELSE 'p' || (o_custkey % 20) END AS producer, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS "at" FROM orders)"""


def _ticks(spark, sf_dir):
    name = F.when(F.col("o_custkey") % 50 == 7, F.concat(F.lit("old"), (F.col("o_orderkey") % 3).cast("string"))).otherwise(F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")))
    return table(spark, sf_dir, "orders").select(name.alias("producer"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("at"))


@query(f"""WITH {_TICKS} SELECT CASE producer WHEN 'old0' THEN 'p0' WHEN 'old1' THEN 'new' ELSE producer END AS producer, max("at") AS "at" FROM ticks GROUP BY 1""")
def renamed_runs(spark, sf_dir):
    return store.renamed_producers(_ticks(spark, sf_dir), {"old0": "p0", "old1": "new"})


@query(f"""WITH {_TICKS}, last AS (SELECT producer, max("at") AS "at" FROM ticks GROUP BY 1) SELECT producer, CASE WHEN producer IN ('p1', 'p2') THEN '2030-01-01T00:00:00Z' ELSE "at" END AS "at" FROM last""")
def recorded_ticks(spark, sf_dir):
    last = _ticks(spark, sf_dir).groupBy("producer").agg(F.max("at").alias("at"))
    now = last.where("producer in ('p1', 'p2')").select("producer", F.lit("2030-01-01T00:00:00Z").alias("at"))
    return runs.record_run(last, now)


@query("SELECT o_orderkey AS id, o_orderstatus = 'O' AS open, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT'")
def scene_kinds(spark, sf_dir):
    scenes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("organized"), "o_orderstatus", F.array(F.struct(F.col("o_orderpriority").alias("id"))).alias("tags"))
    both = tables.unorganized(scenes).unionByName(tables.tagged(scenes, "1-URGENT")).dropDuplicates(["id"])
    return both.select("id", (F.col("o_orderstatus") == "O").alias("open"), F.exists("tags", lambda t: t["id"] == "1-URGENT").alias("urgent"))


# Changes


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ',' || c_name WHEN c_custkey % 4 = 1 THEN '' ELSE c_name END AS aliases FROM customer")
def replaced_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_name").alias("aliases"), "c_mktsegment")
    none = F.array().cast("array<string>")
    wanted = rows.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.array("c_mktsegment"), "aliases")).otherwise(none).alias("aliases"))
    return changes.replace_aliases(rows, wanted).select("id", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_clerk ELSE 'changed' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b,c' END AS tag_ids FROM (SELECT *, 'Clerk ' || o_custkey AS o_clerk FROM orders)")
def reverted_scenes(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("changed").alias("title"), none.alias("details"), none.alias("date"), none.alias("studio_id"), F.array(F.lit("p")).alias("performer_ids"), F.array(F.lit("b"), F.lit("c")).alias("tag_ids"), "o_custkey")
    clerk = F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"))
    prior = F.struct(clerk.alias("title"), *[none.alias(c) for c in ("details", "date", "studio_id")], F.array(F.lit("p")).alias("performer_ids"), F.array(F.lit("a")).alias("tag_ids"))
    return changes.revert_scenes(rows, rows.where("id % 3 = 0").select("id", prior.alias("prior"))).select("id", "title", F.array_join("tag_ids", ",").alias("tag_ids"))



@query("SELECT p_partkey AS loser, CASE WHEN p_size % 2 = 0 AND s_acctbal > 0 THEN 'the survivor has a description' END AS refused FROM part JOIN supplier ON s_suppkey = p_partkey % 9 + 1")
def guarded_merges(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    entities = supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, "told").otherwise("").alias("description"))
    merges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("loser"), (F.col("p_partkey") % 9 + 1).alias("survivor"), F.when(F.col("p_size") % 2 == 0, "mine").alias("description"))
    return changes.merge_guard(entities, merges).select("loser", "refused")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'arm: rose; hand' WHEN 2 THEN 'arm: rose' ELSE 'hand' END AS told FROM supplier")
def told_modifications(spark, sf_dir):
    kind = F.col("s_suppkey") % 4
    one = lambda a, b: F.struct(F.lit(a).alias("location"), F.lit(b).cast("string").alias("description"))
    none = F.array().cast("array<struct<location: string, description: string>>")
    items = F.when(kind == 1, F.array(one("arm", "rose"), one("hand", None))).when(kind == 2, F.array(one("arm", "rose"), one("", None))).when(kind == 3, F.array(one("hand", ""))).otherwise(none)
    return table(spark, sf_dir, "supplier").select("s_suppkey", changes.joined_modifications(items).alias("told"))


# Display


@query(
    f"""WITH {FILES} SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'the file names ' || slug || '; also found at x' ELSE 'the file names ' || slug END
        WHEN id % 2 = 0 THEN 'also found at x' END AS why FROM files"""
)
def disagreements(spark, sf_dir):
    rows = files(spark, sf_dir)
    slug = urls.title_slug(F.col("url")) if "url" in rows.columns else F.col("slug")
    stem = F.when(F.col("id") % 3 == 0, slug).otherwise(F.lit("creator"))
    return rows.select("id", display.disagreement(F.lit("creator"), stem, F.when(F.col("id") % 2 == 0, "x")).alias("why"))


@query(f"WITH {MUTES} SELECT subject_type, subject_id, reason FROM mutes")
def shown_mutes(spark, sf_dir):
    muted = views.mutes(spark, sf_dir)
    none = spark.createDataFrame([], "subject_type string, subject_id string")
    return display.mute_rows(store.standing_mutes(muted, none, views.items(spark, sf_dir))).select("subject_type", "subject_id", "reason")


@query(
    """SELECT o_orderkey, 'every ' || CASE WHEN s % 86400 = 0 THEN s // 86400 || ' d' WHEN s % 3600 = 0 THEN s // 3600 || ' h' WHEN s % 60 = 0 THEN s // 60 || ' min' ELSE s || ' s' END AS cadence
        FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * (o_custkey % 7 + 1) AS s FROM orders)"""
)
def cadences(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    every = F.when(kind == 0, 86400).when(kind == 1, 3600).when(kind == 2, 60).otherwise(1) * (F.col("o_custkey") % 7 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", display.cadence(every).alias("cadence"))


@query(f"SELECT item_id, {normal_sql('text')} AS normal, {normal_sql('text')} = {normal_sql('upper(text)')} AS same FROM benchmark")
def folded_items(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.normalize(F.col("text")).alias("normal"), text.normalize(F.upper("text")).alias("upper"))
    return rows.select("item_id", "normal", (F.col("normal") == F.col("upper")).alias("same"))

"""Driver tables as domain inputs; each view has its SQL for the oracle beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.urls import segment, title_slug
from attesta.plans.registry import key_sql, normal_sql, table


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of documents as labels: id, name, scene_count (documents), description, aliases."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("name")).where("name <> ''")
    counts = words.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("scene_count"))
    told = F.when(F.col("scene_count") % 7 == 0, F.concat(F.lit("seen "), (F.col("scene_count") % 3).cast("string")))
    return counts.select(F.md5(F.col("name")).alias("id"), "name", "scene_count", told.alias("description"), F.array().cast("array<string>").alias("aliases"))


SURFACES = r"""surfaces AS (
    SELECT md5(name) AS id, name, scene_count, CASE WHEN scene_count % 7 = 0 THEN 'seen ' || (scene_count % 3) END AS description
    FROM (SELECT name, count(DISTINCT doc_id) AS scene_count
          FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS name FROM documents) WHERE name <> '' GROUP BY name))"""
CLUSTERS = f"""{SURFACES}, members AS (
    SELECT *, {key_sql("name")} AS key, CASE WHEN {normal_sql("name")} = '' THEN 0 ELSE len(string_split({normal_sql("name")}, ' ')) END AS words FROM surfaces),
    clusters AS (
    SELECT key, count(*) AS n, list(name ORDER BY name, id) AS names, list(id ORDER BY name, id) AS ids, list(words ORDER BY name, id) AS words,
           list(description ORDER BY name, id) FILTER (WHERE trim(coalesce(description, '')) <> '') AS texts,
           list(id ORDER BY name, id) FILTER (WHERE trim(coalesce(description, '')) <> '') AS carriers
    FROM members WHERE key <> '' GROUP BY key HAVING count(*) >= 2),
    decided AS (
    SELECT *, CASE WHEN n = 2 AND words[1] <> words[2] THEN CASE WHEN words[1] > words[2] THEN ids[1] ELSE ids[2] END END AS canonical,
           CASE WHEN n > 2 THEN 'many' WHEN words[1] = words[2] THEN 'even' END AS undecided FROM clusters)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as library files: id, path, name, folder, host, slug."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), segment(F.col("url"), 0).alias("host"), title_slug(F.col("url")).alias("slug"))
    kind = F.col("id") % 4
    folder = F.when(kind == 0, F.lit("Videos")).when(kind == 1, F.col("host")).when(kind == 2, F.concat("host", F.lit(" (h265)/Clips"))).otherwise(F.concat("host", F.lit("/1080p/Downloads")))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MKV", "", ".html", ".mpeg")]), (F.col("id") % 5 + 1).cast("int"))
    rows = pages.withColumn("name", F.concat("slug", ext))
    return rows.withColumn("folder", folder).withColumn("path", F.concat(F.lit("/lib/"), "folder", F.lit("/"), "name"))


FILES = r"""files AS (
    SELECT id, host, slug, slug || ['.mp4', '.MKV', '', '.html', '.mpeg'][id % 5 + 1] AS name
    FROM (SELECT page_id AS id, segments[1] AS host, segments[-1] AS slug
          FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[^?#]*?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS segments FROM pages)))"""


#: Folders that name nobody, one for each guard of attribution.is_name.
SHELVES = ("AB", "Kept From An Older Disk", "2023 September 11", "20230911", "Sep 2023", "The Latest", "Downloads")


def filed(part: DataFrame) -> DataFrame:
    """Parts as library files: ``part`` with maker, name and folder.

    Most lie in a folder of their maker. Others, by size and name, lie on a shelf that names nobody, and the name says the maker first.
    """
    maker = F.concat_ws(" ", "p_brand", "p_type", "p_size")
    shelf = F.get(F.array(*[F.lit(x) for x in SHELVES]), (F.col("p_size") + F.length("p_name")) % 16)  # null beyond the last
    name = F.when(shelf.isNull(), F.col("p_name")).otherwise(F.concat(maker, F.lit(" - "), "p_name"))
    return part.withColumns({"maker": maker, "name": F.concat(name, F.lit(".mp4")), "folder": F.coalesce(shelf, maker)})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored candidates: subject, idx, value, contained, meaningful, title, store, resolvable."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    # idx tells all rows of an order apart, as line numbers repeat
    idx = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    rows = lines.select(
        F.col("l_orderkey").alias("subject"), idx.cast("long").alias("idx"), F.round(F.col("l_quantity") / 50, 3).alias("value"), (F.col("l_returnflag") == "R").alias("contained"),
        (F.col("l_linenumber") % 3).alias("meaningful"), "title", F.concat(F.lit("store"), (F.col("l_suppkey") % 3).cast("string")).alias("store"), (F.col("l_suppkey") % 3 > 0).alias("resolvable"),
    )
    return rows.groupBy("subject", "idx").agg(*[F.max(c).alias(c) for c in ("value", "contained", "meaningful", "title", "store", "resolvable")])


CANDIDATES = f"""candidates AS (
    SELECT l_orderkey AS subject, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS idx, max(round(l_quantity / 50, 3)) AS value,
           max(l_returnflag = 'R') AS contained, max(l_linenumber % 3) AS meaningful, max(p_name) AS title, max({normal_sql("p_name")}) AS normal,
           max('store' || (l_suppkey % 3)) AS store, max(l_suppkey % 3 > 0) AS resolvable
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
    judged AS (
    SELECT *, CASE WHEN meaningful = 0 THEN false WHEN contained THEN true WHEN meaningful < 2 THEN value >= 0.9 ELSE value >= 0.7 END AS eligible,
           CASE WHEN meaningful = 0 THEN 1e308 WHEN meaningful < 2 THEN 0.9 - value ELSE 0.7 - value END AS short FROM candidates),
    tied AS (
    SELECT *, eligible AND round(max(value) FILTER (WHERE eligible) OVER (PARTITION BY subject) - value, 3) <= 0.05 AS tied FROM judged),
    grouped AS (
    SELECT subject, count(*) FILTER (WHERE eligible) AS contenders, count(*) FILTER (WHERE tied) AS n_tied, count(DISTINCT normal) FILTER (WHERE tied) AS n_titles,
           bool_and(meaningful > 0) AS interrogated,
           first(idx ORDER BY value DESC, idx) FILTER (WHERE eligible) AS top_idx, first(idx ORDER BY title, idx) FILTER (WHERE tied) AS agreed_idx,
           first(idx ORDER BY short, value DESC, idx) AS near FROM tied GROUP BY subject),
    decisions AS (
    SELECT g.subject, outcome, c.idx, c.value, c.title, contenders, interrogated, CASE WHEN outcome = 'none' THEN near END AS near_idx
    FROM (SELECT *, CASE WHEN contenders = 0 THEN 'none' WHEN n_tied > 1 AND n_titles > 1 THEN 'ambiguous' ELSE 'chosen' END AS outcome FROM grouped) g
    LEFT JOIN candidates c ON c.subject = g.subject AND outcome = 'chosen' AND c.idx = CASE WHEN n_tied > 1 THEN agreed_idx ELSE top_idx END)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fingerprint claims: subject, box, ord, site_id, algorithm, exact."""
    lines = table(spark, sf_dir, "lineitem")
    algorithm = F.when(F.col("l_returnflag") == "A", "MD5").when(F.col("l_returnflag") == "N", "OSHASH").otherwise("PHASH")
    rows = lines.select(
        F.col("l_orderkey").alias("subject"), F.concat(F.lit("box"), F.col("l_suppkey").cast("string")).alias("box"), F.col("l_suppkey").alias("ord"),
        F.when(F.col("l_partkey") % 11 > 0, (F.col("l_partkey") % 2).cast("string")).alias("site_id"), algorithm.alias("algorithm"),
    )
    return rows.withColumn("exact", F.col("algorithm").isin("MD5", "OSHASH"))


CLAIMS = """claims AS (
    SELECT l_orderkey AS subject, 'box' || l_suppkey AS box, l_suppkey AS ord, CASE WHEN l_partkey % 11 > 0 THEN CAST(l_partkey % 2 AS VARCHAR) END AS site_id,
           l_returnflag IN ('A', 'N') AS exact FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals, in the columns of the item table."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    state = F.when(key % 10 == 0, "dismissed").when(key % 10 == 1, "gone").when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "P", "seen").otherwise("new")
    kinds = ("scene", "tag", "tag-cluster", "tag-performer", "tag-unused", "performer", "performer-enrichment", "other")
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("o_custkey") % 8 + 1).cast("int"))
    at = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.concat(F.lit("fp"), key.cast("string")).alias("fingerprint"), F.col("o_orderpriority").alias("folder"), kind.alias("subject_type"), F.col("o_custkey").cast("string").alias("subject_id"),
        F.concat(F.lit("order "), key.cast("string")).alias("summary"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("confidence"), F.lit("{}").alias("payload"),
        F.lit("orders").alias("producer"), state.alias("state"), F.lit(None).cast("string").alias("prior_state"), F.lit(None).cast("string").alias("error"), at.alias("created_at"),
        (at + F.expr("interval 1 day") * (key % 5)).alias("last_seen_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )


ITEMS = """items AS (
    SELECT 'fp' || o_orderkey AS fingerprint, o_orderpriority AS folder,
           ['scene', 'tag', 'tag-cluster', 'tag-performer', 'tag-unused', 'performer', 'performer-enrichment', 'other'][o_custkey % 8 + 1] AS subject_type,
           CAST(o_custkey AS VARCHAR) AS subject_id, 'order ' || o_orderkey AS summary, least(o_totalprice / 500000, 1.0) AS confidence,
           CASE WHEN o_orderkey % 10 = 0 THEN 'dismissed' WHEN o_orderkey % 10 = 1 THEN 'gone' WHEN o_orderstatus = 'F' THEN 'applied'
                WHEN o_orderstatus = 'P' THEN 'seen' ELSE 'new' END AS state,
           o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS last_seen_at
    FROM orders)"""
VISIBLE = "state NOT IN ('dismissed', 'muted', 'superseded', 'gone')"


def mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt as muted subjects of the type that their items have."""
    kinds = ("scene", "tag", "tag-cluster", "tag-performer", "tag-unused", "performer", "performer-enrichment", "other")
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("c_custkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return rows.select(kind.alias("subject_type"), F.col("c_custkey").cast("string").alias("subject_id"), F.col("c_mktsegment").alias("reason"), F.lit("2024-01-01").cast("timestamp").alias("at"))


MUTES = """mutes AS (
    SELECT ['scene', 'tag', 'tag-cluster', 'tag-performer', 'tag-unused', 'performer', 'performer-enrichment', 'other'][c_custkey % 8 + 1] AS subject_type,
           CAST(c_custkey AS VARCHAR) AS subject_id, c_mktsegment AS reason FROM customer WHERE c_acctbal < 0)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs, in the columns of the run table; every ninth is open."""
    rows = table(spark, sf_dir, "events")
    start = F.date_trunc("minute", F.col("ts").cast("timestamp"))  # so that starts tie
    open_ = F.col("event_id") % 9 == 0
    return rows.select(
        F.concat(F.lit("run"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("job"), F.lit("schedule").alias("trigger"), start.alias("started"),
        F.when(~open_, start + F.expr("interval 1 minute")).alias("finished"), F.when(~open_, F.when(F.col("event_type") == "error", "failed").otherwise("finished")).alias("outcome"),
        F.lit(None).cast("map<string, bigint>").alias("counts"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("seq"),
    )


RUN_LOG = """run_log AS (
    SELECT 'run' || event_id AS id, event_type AS job, date_trunc('minute', ts) AS started,
           CASE WHEN event_id % 9 > 0 THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE END AS finished,
           CASE WHEN event_id % 9 > 0 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'finished' END END AS outcome, event_id AS seq FROM events)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people: id, name, aliases (the segment with a number, some shared; some another person's name)."""
    rows = table(spark, sf_dir, "customer")
    alias = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 97).cast("string"))
    other = F.concat(F.lit("Customer#"), F.lpad(((F.col("c_custkey") * 7) % 5000).cast("string"), 9, "0"))
    aliases = F.when(F.col("c_custkey") % 10 == 0, F.array(alias, other)).otherwise(F.array(alias))
    return rows.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), aliases.alias("aliases"), F.col("c_nationkey").cast("string").alias("site_id"))


PEOPLE = """people AS (
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS site_id,
           CASE WHEN c_custkey % 10 = 0 THEN [c_mktsegment || ' ' || (c_custkey % 97), 'Customer#' || lpad(CAST((c_custkey * 7) % 5000 AS VARCHAR), 9, '0')]
                ELSE [c_mktsegment || ' ' || (c_custkey % 97)] END AS aliases FROM customer)"""

"""Queries over labels, people, offers and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.text import spaceless
from attesta.functions.vocab import NAMED_REFERENCES, TAG_NAMES
from attesta.operators import labels, profiles
from attesta.plans import views
from attesta.plans.registry import key_sql, query, table
from attesta.plans.views import CLUSTERS, PEOPLE, SURFACES
from attesta.session import written_once


@query(f"WITH {CLUSTERS} SELECT key, n, array_to_string(names, '|') AS names, canonical, undecided FROM decided")
def label_clusters(spark, sf_dir):
    rows = labels.cluster_labels(views.surfaces(spark, sf_dir))
    return rows.select("key", F.size("members").cast("long").alias("n"), F.array_join("members.name", "|").alias("names"), "canonical", "undecided")


@query(f"WITH {CLUSTERS} SELECT coalesce(undecided, 'chosen') AS choice, count(*) AS n FROM decided GROUP BY 1")
def survivor_choice(spark, sf_dir):
    rows = labels.cluster_labels(views.surfaces(spark, sf_dir))
    return rows.groupBy(F.coalesce("undecided", F.lit("chosen")).alias("choice")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {CLUSTERS}, d AS (SELECT key, canonical, CASE WHEN canonical IS NULL THEN 'none' WHEN len(list_distinct(texts)) > 1 THEN 'conflicting' WHEN texts IS NULL THEN 'source'
            WHEN list_contains(carriers, canonical) THEN 'kept' ELSE 'inherit' END AS outcome, texts[1] AS text, carriers[1] AS carrier FROM decided)
        SELECT key, canonical, outcome, CASE WHEN outcome = 'inherit' THEN carrier END AS from_id, CASE WHEN outcome = 'inherit' THEN text END AS description FROM d"""
)
def merge_inherit(spark, sf_dir):
    return labels.merge_descriptions(labels.cluster_labels(views.surfaces(spark, sf_dir)))


def _source(spark, sf_dir):
    """Parts as a source's labels: names repeat, some with different texts."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("description"))


_INDEX = f"""source AS (SELECT unnest([p_name, p_brand]) AS name, p_type AS description FROM part WHERE p_size % 3 > 0),
    idx AS (SELECT {key_sql("name")} AS key, min(description) AS description, count(DISTINCT description) > 1 AS ambiguous FROM source WHERE {key_sql("name")} <> '' GROUP BY 1)"""


@query(f"WITH {_INDEX} SELECT key, CASE WHEN NOT ambiguous THEN description END AS description, ambiguous FROM idx")
def describe_index(spark, sf_dir):
    return labels.description_index(_source(spark, sf_dir))


def _indexes(spark, sf_dir, words):
    words = words.where("description is not null").select("name", "aliases", "description")
    first = labels.description_index(_source(spark, sf_dir)).withColumns({"source": F.lit("parts"), "ord": F.lit(0)})
    return first.unionByName(labels.description_index(words).withColumns({"source": F.lit("words"), "ord": F.lit(1)}))


_BOTH = f"""{_INDEX}, {SURFACES}, widx AS (SELECT {key_sql("name")} AS key, min(description) AS description, count(DISTINCT description) > 1 AS ambiguous
        FROM surfaces WHERE description IS NOT NULL AND {key_sql("name")} <> '' GROUP BY 1),
    every AS (SELECT key, description, 'parts' AS source, 0 AS ord FROM idx WHERE NOT ambiguous UNION ALL SELECT key, description, 'words', 1 FROM widx WHERE NOT ambiguous),
    firsts AS (SELECT key, first(description ORDER BY ord) AS description, first(source ORDER BY ord) AS source FROM every GROUP BY key)"""


@query(f"WITH {_BOTH} SELECT s.id, f.description, f.source FROM surfaces s JOIN firsts f ON f.key = {key_sql('s.name')}")
def describe_first(spark, sf_dir):
    words = written_once(views.surfaces(spark, sf_dir))  # read once for all branches
    return labels.find_descriptions(words, _indexes(spark, sf_dir, words))


@query(f"WITH {SURFACES} SELECT CASE scene_count WHEN 0 THEN 'no-scenes' WHEN 1 THEN 'one-scene' END AS usage, count(*) AS n FROM surfaces WHERE scene_count <= 1 GROUP BY 1")
def low_count_labels(spark, sf_dir):
    rows = views.surfaces(spark, sf_dir).withColumn("usage", labels.usage_group(F.col("scene_count"))).where("usage is not null")
    return rows.groupBy("usage").agg(F.count(F.lit(1)).alias("n"))


_HYGIENE = f"""{_BOTH}, ks AS (SELECT *, {key_sql("name")} AS key FROM surfaces),
    judged AS (SELECT id, CASE WHEN trim(coalesce(description, '')) <> '' THEN 'described' WHEN key IN (SELECT key FROM firsts) THEN 'sourced'
        WHEN key <> '' AND key IN (SELECT key FROM ks GROUP BY key HAVING count(*) >= 2) THEN 'clustered' WHEN left(id, 1) = 'a' THEN 'reconciled'
        WHEN left(id, 1) = 'b' THEN 'kept' WHEN left(id, 1) = 'c' THEN 'already' ELSE 'proposed' END AS reason FROM ks WHERE scene_count <= 1)"""


@query(f"WITH {_HYGIENE} SELECT reason, count(*) AS n FROM judged GROUP BY 1")
def hygiene_counts(spark, sf_dir):
    words = written_once(views.surfaces(spark, sf_dir))  # read once for all branches
    starts = lambda letter: words.where(F.substring("id", 1, 1) == letter).select("id")
    clustered = labels.cluster_labels(words).select(F.explode("members.id").alias("id"))
    sourced = labels.find_descriptions(words, _indexes(spark, sf_dir, words)).select("id")
    rows = labels.hygiene(words, sourced, clustered, starts("a"), starts("b"), starts("c"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PERSON_LABELS = "tags AS (SELECT DISTINCT c_mktsegment || ' ' || (c_custkey % 97) AS name, CAST(c_custkey % 97 % 2 AS BIGINT) AS scene_count FROM customer)"


@query(
    f"""WITH {PEOPLE}, {_PERSON_LABELS}, spelled AS (SELECT id, name, {key_sql("name")} AS key, 0 AS via FROM people
            UNION ALL SELECT id, name, {key_sql("alias")}, 1 FROM (SELECT id, name, unnest(aliases) AS alias FROM people)),
        one AS (SELECT key, id, name, min(via) AS via FROM spelled WHERE key <> '' GROUP BY 1, 2, 3),
        idx AS (SELECT key, count(*) AS n, string_agg(id, ',' ORDER BY name, id) AS ids, min(id) AS id FROM one GROUP BY key)
        SELECT t.name, idx.n AS n_matches, idx.ids, CASE WHEN scene_count = 0 THEN 'unused' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome,
            CASE WHEN scene_count > 0 AND n = 1 THEN idx.id END AS person_id FROM tags t JOIN idx ON idx.key = {key_sql("t.name")}"""
)
def label_person_match(spark, sf_dir):
    tags = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 97).cast("string")).alias("name"), (F.col("c_custkey") % 97 % 2).alias("scene_count")).distinct()
    rows = labels.match_people(tags, labels.index_people(views.people(spark, sf_dir)))
    return rows.select("name", F.size("matches").cast("long").alias("n_matches"), F.array_join("matches.id", ",").alias("ids"), "outcome", "person_id")


_IDS = "ids AS (SELECT c_mktsegment || (c_custkey % 300) AS name, list_sort(list_distinct(list(CAST(c_nationkey AS VARCHAR)))) AS ids FROM customer GROUP BY 1)"


def _derived(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 300).cast("string")).alias("name"), F.col("c_nationkey").cast("string").alias("site_id"))
    return profiles.derive_ids(rows)


@query(f"WITH {_IDS} SELECT name, CASE WHEN len(ids) = 1 THEN ids[1] END AS site_id, CASE WHEN len(ids) > 1 THEN array_to_string(ids, ',') END AS ambiguous FROM ids")
def derive_ids(spark, sf_dir):
    return _derived(spark, sf_dir).withColumn("ambiguous", F.array_join("ambiguous", ","))


@query(
    f"""WITH {_IDS}, m AS (SELECT 'BUILDING' || r_regionkey AS name, 'm' || r_regionkey AS site_id FROM region)
        SELECT coalesce(m.name, ids.name) AS name, coalesce(m.site_id, CASE WHEN len(ids) = 1 THEN ids[1] END) AS site_id,
            coalesce(m.site_id, CASE WHEN len(ids) = 1 THEN ids[1] END) IS NULL AS unresolved FROM m FULL JOIN ids ON m.name = ids.name"""
)
def merge_ids(spark, sf_dir):
    key = F.col("r_regionkey").cast("string")
    manual = table(spark, sf_dir, "region").select(F.concat(F.lit("BUILDING"), key).alias("name"), F.concat(F.lit("m"), key).alias("site_id"))
    return profiles.merge_ids(manual, _derived(spark, sf_dir))


@query(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'country' END, CASE WHEN c_custkey % 3 = 0 THEN 'gender' END,
        CASE WHEN c_custkey % 5 = 0 THEN 'urls' END, CASE WHEN c_custkey % 7 = 0 THEN 'image' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer"""
)
def missing_fields(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 2 == 0, "").otherwise("x").alias("country"), F.when(key % 3 > 0, "y").alias("gender"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_name")).alias("urls"),
        F.when(key % 7 == 0, "/img?default=true").otherwise("/img").alias("image_path"),
    )
    return rows.select("c_custkey", F.array_join(profiles.missing_fields(("country", "gender", "urls")), ",").alias("missing"))


_OFFERS = """offers AS (SELECT o_custkey AS id, 'priority' AS field, o_orderkey AS ord, o_orderpriority AS value FROM orders
    UNION ALL SELECT o_custkey, 'status', o_orderkey, o_orderstatus FROM orders)"""


@query(
    f"""WITH {_OFFERS} SELECT id, field, count(DISTINCT {key_sql("value")}) = 1 AS agreed, CASE WHEN count(DISTINCT {key_sql("value")}) = 1 THEN first(value ORDER BY ord) END AS value,
        CASE WHEN count(DISTINCT {key_sql("value")}) > 1 THEN string_agg(value, ',' ORDER BY ord) END AS conflict FROM offers GROUP BY 1, 2"""
)
def merge_offers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = lambda rows, field, column: rows.select(
        F.col("o_custkey").alias("id"), F.lit(field).alias("field"), F.col("o_orderkey").alias("ord"), F.lit("orders").alias("source"), F.col(column).alias("value")
    )
    offers = one(orders, "priority", "o_orderpriority").unionByName(one(orders, "status", "o_orderstatus"))
    return profiles.merge_offers(offers).withColumn("conflict", F.array_join("conflict.value", ","))


@query(
    f"""WITH {PEOPLE}, p AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') AS name FROM supplier)
        SELECT people.id, p.id AS profile_id FROM people JOIN p ON CASE WHEN CAST(people.id AS BIGINT) % 2 = 0 THEN p.id = people.site_id ELSE {key_sql("p.name")} = {key_sql("people.name")} END"""
)
def enrichment_candidates(spark, sf_dir):
    folk = views.people(spark, sf_dir)
    known = F.when(F.col("id").cast("long") % 2 == 0, F.array(F.struct(F.lit("box").alias("endpoint"), F.col("site_id").alias("stash_id")))).otherwise(F.array().cast("array<struct<endpoint: string, stash_id: string>>"))
    rows = folk.select("id", "name", known.alias("stash_ids"))
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"))
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))
    return profiles.enrichment_candidates(rows, found, "box").select("id", F.col("profile.id").alias("profile_id"))


_MARKUP = r"</?(?:" + "|".join(sorted(TAG_NAMES, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>"
_ENTITY = "&(?:" + "|".join(sorted(NAMED_REFERENCES)) + ");"
_DECODED = f"regexp_replace(d, '[ \\t]*(?:(?:{_MARKUP})[ \\t]*)+', ' ', 'gi')"
for _name in (*sorted(set(NAMED_REFERENCES) - {"amp"}), "amp"):  # the sign of references last, so none is decoded twice
    _DECODED = f"replace({_DECODED}, '&{_name};', '{NAMED_REFERENCES[_name].replace(chr(39), chr(39) * 2)}')"
_FAULTS = "array_to_string(list_filter([CASE WHEN regexp_matches({0}, '" + _MARKUP + "', 'i') THEN 'markup' END, CASE WHEN regexp_matches({0}, '" + _ENTITY + "') THEN 'entity' END], lambda x: x IS NOT NULL), ',')"


@query(
    rf"""WITH parts AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages),
        d AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS d FROM parts),
        c AS (SELECT page_id, place, {_FAULTS.format("d")} AS faults, regexp_replace(regexp_replace({_DECODED}, '[ 	]*
[ 	]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM d),
        r AS (SELECT *, CASE WHEN faults = '' THEN NULL WHEN plain = '' THEN 'nothing left' WHEN {_FAULTS.format("plain")} <> '' THEN 'double encoded' END AS reason FROM c)
        SELECT page_id, CAST(place AS INTEGER) AS place, nullif(faults, '') AS faults, CASE WHEN faults <> '' AND reason IS NULL THEN plain END AS cleaned, reason,
               CASE WHEN faults = '' THEN 'clean' WHEN reason IS NULL THEN 'proposed' ELSE 'refused' END AS outcome FROM r"""
)
def clean_description(spark, sf_dir):
    """Paragraphs of pages, their markup and references cleaned or refused."""
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))).alias("place", "description"))
    return profiles.description_outcomes(parts).select("page_id", "place", "faults", "cleaned", "reason", "outcome")


@query(
    """SELECT page_id, (length(html) - length(regexp_replace(html, '&(amp|copy|middot|quot);', '', 'g'))) > 0 AS entity FROM pages"""
)
def description_faults(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_contains(profiles.faults(F.col("html")), "entity").alias("entity"))


@query(f"SELECT c_custkey, {key_sql('c_name')} = {key_sql(chr(39) + 'customer ' + chr(39) + ' || lpad(CAST(c_custkey AS VARCHAR), 9, ' + chr(39) + '0' + chr(39) + ')')} AS same FROM customer")
def matches_name(spark, sf_dir):
    wanted = F.concat(F.lit("customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", profiles.matches_name(wanted, F.col("c_name"), F.array().cast("array<string>")).alias("same"))


def flagship(spark, sf_dir):
    """The flagship query: spelling clusters of labels."""
    return label_clusters(spark, sf_dir).withColumn("key", spaceless(F.col("key")))

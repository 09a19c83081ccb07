"""Queries over attribution, scoring, decisions, claims, listings and searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import similarity
from attesta.functions.text import normalize, tokens
from attesta.operators import adapters, attribution, claims, decisions, linkage, listings, matching, selection
from attesta.plans import views
from attesta.plans.registry import key_sql, query, table, tokens_sql
from attesta.plans.views import CANDIDATES, CLAIMS, PEOPLE
from attesta.session import few, parts_for, spread, written_once


@query(f"WITH {CANDIDATES} SELECT * FROM decisions")
def decide(spark, sf_dir):
    return decisions.decide(views.candidates(spark, sf_dir))


@query(
    f"""WITH {CANDIDATES} SELECT subject, idx, value, title, place FROM (
        SELECT c.subject, c.idx, c.value, c.title, CAST(row_number() OVER (PARTITION BY c.subject ORDER BY c.value DESC, c.title, c.idx) AS INTEGER) AS place
        FROM candidates c JOIN decisions d ON c.subject = d.subject AND d.outcome = 'chosen' AND c.idx <> d.idx) WHERE place <= 3"""
)
def runners_up(spark, sf_dir):
    rows = views.candidates(spark, sf_dir)
    return decisions.runners_up(rows, decisions.decide(rows))


_BEST = "best AS (SELECT subject, store, max(resolvable) AS resolvable, max(value) AS value, first(title ORDER BY value DESC, idx) AS title, first(normal ORDER BY value DESC, idx) AS normal FROM candidates GROUP BY subject, store)"


def _best(spark, sf_dir):
    rows = views.candidates(spark, sf_dir)
    pick = F.max_by("title", F.struct("value", -F.col("idx")))
    return rows.groupBy("subject", "store").agg(F.max("resolvable").alias("resolvable"), F.max("value").alias("value"), pick.alias("title"))


@query(
    f"""WITH {CANDIDATES}, {_BEST}, top AS (SELECT *, max(value) OVER (PARTITION BY subject) AS top FROM best b
            WHERE resolvable = (SELECT max(resolvable) FROM best x WHERE x.subject = b.subject)),
        g AS (SELECT subject, count(DISTINCT normal) FILTER (WHERE round(top - value, 3) <= 0.05) AS n, first(store ORDER BY value DESC, store) AS store,
            first(normal ORDER BY value DESC, store) AS normal, first(title ORDER BY value DESC, store) AS title, max(value) AS value FROM top GROUP BY subject)
        SELECT g.subject, CASE WHEN n = 1 THEN g.store END AS store, CASE WHEN n = 1 THEN g.value END AS value, CASE WHEN n = 1 THEN g.title END AS title, n <> 1 AS ambiguous,
            CASE WHEN n = 1 THEN coalesce(string_agg(t.store, ',' ORDER BY t.store) FILTER (WHERE t.store <> g.store AND t.normal = g.normal), '') END AS agreeing,
            CASE WHEN n = 1 THEN coalesce(string_agg(t.store, ',' ORDER BY t.store) FILTER (WHERE t.store <> g.store AND t.normal <> g.normal), '') END AS competing
        FROM g JOIN top t ON t.subject = g.subject GROUP BY g.subject, g.store, g.value, g.title, g.normal, n"""
)
def choose_winner(spark, sf_dir):
    return decisions.choose_winner(_best(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("agreeing", "competing")})


@query(f"WITH {CANDIDATES}, b AS (SELECT subject, store, max(value) AS best FROM candidates GROUP BY 1, 2) SELECT subject, first(store ORDER BY best DESC, store) AS store, max(best) AS best FROM b GROUP BY subject")
def closest_refusal(spark, sf_dir):
    return decisions.closest_refusal(views.candidates(spark, sf_dir))


@query(
    f"""WITH {CANDIDATES}, s AS (SELECT o_orderkey AS subject, 'store' || k AS store, CASE WHEN (o_orderkey + k) % 13 = 0 THEN 'timeout' END AS error FROM orders, (VALUES (0), (1), (2)) v(k)),
        f AS (SELECT subject, store, count(*) AS rows, max(value) AS score, first(title ORDER BY value DESC, idx) AS title FROM candidates GROUP BY 1, 2)
        SELECT s.subject, s.store, coalesce(f.rows, 0) AS rows, f.score, f.title, CAST(NULL AS VARCHAR) AS url, s.error,
            CAST(row_number() OVER (PARTITION BY s.subject ORDER BY f.score DESC NULLS LAST, s.store) AS INTEGER) AS place
        FROM s LEFT JOIN f ON s.subject = f.subject AND s.store = f.store"""
)
def store_reports(spark, sf_dir):
    rows = views.candidates(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    error = F.when((F.col("subject") + F.col("k")) % 13 == 0, "timeout")
    return decisions.store_reports(asked.select("subject", F.concat(F.lit("store"), F.col("k").cast("string")).alias("store"), error.alias("error")), rows)


_RESOLVED = f"""{CLAIMS}, g AS (
    SELECT subject, count(*) FILTER (WHERE exact) AS n_exact, count(DISTINCT site_id) FILTER (WHERE exact) AS n_ids, bool_or(site_id IS NULL) FILTER (WHERE exact) AS unknown,
        first(box ORDER BY ord, site_id NULLS FIRST) FILTER (WHERE exact) AS box, first(site_id ORDER BY ord, site_id NULLS FIRST) FILTER (WHERE exact) AS site_id,
        list_distinct(list(box) FILTER (WHERE exact)) AS boxes, list_distinct(list(site_id) FILTER (WHERE NOT exact AND site_id IS NOT NULL)) AS likes
    FROM claims GROUP BY subject),
    r AS (SELECT *, CASE WHEN n_exact = 1 OR (n_ids = 1 AND NOT unknown) THEN 'identified' ELSE 'conflict' END AS outcome FROM g WHERE n_exact > 0)"""


@query(
    f"""WITH {_RESOLVED} SELECT subject, outcome, CASE WHEN outcome = 'identified' THEN site_id END AS site_id, CASE WHEN outcome = 'identified' THEN box END AS box,
        CASE WHEN outcome = 'identified' THEN array_to_string(list_sort(list_filter(boxes, lambda x: (x <> box))), ',') END AS agreeing,
        CASE WHEN outcome = 'identified' THEN coalesce(array_to_string(list_sort(list_filter(likes, lambda x: (x <> coalesce(site_id, '~')))), ','), '') END AS perceptual FROM r"""
)
def resolve_claims(spark, sf_dir):
    return claims.resolve_claims(views.claims(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("agreeing", "perceptual")})


@query("SELECT l_orderkey AS subject, bool_or(l_returnflag IN ('A', 'N')) AS exact, count(*) AS n FROM lineitem GROUP BY 1")
def exact_hits(spark, sf_dir):
    rows = views.claims(spark, sf_dir).groupBy("subject").agg(F.collect_list(F.struct("algorithm", F.col("box").alias("hash"))).alias("fingerprints"))
    return rows.select("subject", claims.is_exact_hit(F.col("fingerprints")).alias("exact"), F.size("fingerprints").cast("long").alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'MD5' WHEN 'N' THEN 'OSHASH' ELSE 'PHASH' END AS algorithm, CAST(l_partkey AS VARCHAR) AS hash FROM lineitem),
        l AS (SELECT 'MD5' AS algorithm, CAST(p_partkey AS VARCHAR) AS hash, p_brand AS site_id FROM part)
        SELECT a.algorithm, a.hash, coalesce(string_agg(l.site_id, ',' ORDER BY l.site_id), '') AS hits FROM a LEFT JOIN l ON a.algorithm = l.algorithm AND a.hash = l.hash GROUP BY 1, 2"""
)
def known_by_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "MD5").when(F.col("l_returnflag") == "N", "OSHASH").otherwise("PHASH").alias("algorithm"), F.col("l_partkey").cast("string").alias("hash")
    )
    listing = table(spark, sf_dir, "part").select(F.lit("MD5").alias("algorithm"), F.col("p_partkey").cast("string").alias("hash"), F.col("p_brand").alias("site_id"))
    return claims.known_by_fingerprint(rows, listing).withColumn("hits", F.array_join("hits", ","))


@query(
    f"""WITH {CANDIDATES}, r AS (SELECT d.*, coalesce(n, 0) AS rows, d.subject % 3 > 0 AS complete, d.subject % 5 > 0 AS certain
            FROM decisions d LEFT JOIN (SELECT subject, count(*) AS n FROM candidates GROUP BY 1) c USING (subject)),
        v AS (SELECT subject, CASE WHEN NOT certain THEN 'attribution uncertain' WHEN outcome = 'chosen' THEN 'present' WHEN contenders > 0 THEN 'contenders undecided'
            WHEN NOT interrogated AND rows > 0 THEN 'no evidence in the name' WHEN NOT complete THEN 'listing incomplete' ELSE 'unlisted' END AS why FROM r)
        SELECT subject, why, CASE why WHEN 'unlisted' THEN true WHEN 'present' THEN false END AS unlisted FROM v"""
)
def listing_verdict(spark, sf_dir):
    rows = views.candidates(spark, sf_dir)
    made = decisions.decide(rows).join(rows.groupBy("subject").agg(F.count(F.lit(1)).alias("rows")), "subject", "left")
    own = F.col("subject") % 7
    facts = made.withColumns({"complete": F.col("subject") % 3 > 0, "certain": F.col("subject") % 5 > 0, "performer_id": own, "listing_performer_id": own})
    return listings.listing_verdict(facts).select("subject", "why", "unlisted")


@query(
    """SELECT 'seller' || l_suppkey AS source, CAST(sum(q) AS BIGINT) AS rows, sum(q) >= first(reported ORDER BY page) AS complete, count(*) AS pages_read
        FROM (SELECT l_suppkey, l_orderkey AS page, count(*) AS q, min(l_partkey) + 400 AS reported FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def listing_completeness(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_orderkey").alias("page")).agg(F.count(F.lit(1)).alias("rows"), (F.min("l_partkey") + 400).alias("reported"))
    return listings.listing_completeness(pages.withColumn("source", F.concat(F.lit("seller"), F.col("l_suppkey").cast("string"))))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text), lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", adapters.identity(F.col("lang"), F.md5("text"), F.array().cast("array<string>")).alias("identity"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("identity").orderBy("doc_id"))).where("n = 1").select("doc_id")


@query(
    """WITH l AS (SELECT p_name AS query, CAST(p_partkey AS BIGINT) AS row_ix, p_brand AS code, p_type AS title FROM part)
        SELECT name, code, title, min(row_ix) AS row_ix FROM (SELECT DISTINCT p_name AS name FROM part) n JOIN l ON l.query = n.name GROUP BY 1, 2, 3"""
)
def catalog_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    listing = part.select(F.col("p_name").alias("query"), F.col("p_partkey").alias("row_ix"), F.col("p_brand").alias("code"), F.col("p_type").alias("title"), F.array().cast("array<string>").alias("urls"))
    return adapters.catalog_search(part.select(F.col("p_name").alias("name")), listing, {"steel": ["stl"]}).select("name", "code", "title", "row_ix")


_CANDIDATE_ROWS = "cand AS (SELECT DISTINCT l_orderkey AS id, 'Brand#' || (l_partkey % 40) AS candidate FROM lineitem)"
_SUPPORT = f"""{_CANDIDATE_ROWS}, owners AS (SELECT 'Brand#' || (p_partkey % 40) AS candidate, p_brand AS owner FROM part),
    support AS (SELECT c.id, c.candidate, count(*) FILTER (WHERE {key_sql("owner")} = {key_sql("c.candidate")}) AS exact,
        count(*) FILTER (WHERE {key_sql("owner")} <> {key_sql("c.candidate")} AND starts_with({key_sql("owner")}, {key_sql("c.candidate")})) AS prefix
        FROM cand c LEFT JOIN owners o ON o.candidate = c.candidate GROUP BY 1, 2)"""


def _evidence_inputs(spark, sf_dir):
    brand = lambda c: F.concat(F.lit("Brand#"), (F.col(c) % 40).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), brand("l_partkey").alias("candidate"))
    rows = spread(rows, "id").groupBy("id", "candidate").agg(F.lit(0).alias("ordinal"))
    return rows, table(spark, sf_dir, "part").select(brand("p_partkey").alias("candidate"), F.col("p_brand").alias("owner"))


@query(f"WITH {_SUPPORT} SELECT *, exact >= 1 OR prefix >= 2 AS supported FROM support")
def owner_support(spark, sf_dir):
    rows, owners = _evidence_inputs(spark, sf_dir)
    return attribution.owner_support(rows.select("id", "candidate"), owners)


@query(
    f"""WITH {_SUPPORT} SELECT id, CASE WHEN count(*) = 1 THEN min(candidate) WHEN count(*) FILTER (WHERE exact >= 1 OR prefix >= 2) = 1
            THEN min(candidate) FILTER (WHERE exact >= 1 OR prefix >= 2) END AS resolved,
        CAST(CASE WHEN count(*) > 1 AND count(*) FILTER (WHERE exact >= 1 OR prefix >= 2) <> 1 THEN count(*) ELSE 0 END AS INTEGER) AS unconfirmed FROM support GROUP BY id"""
)
def evidence_resolution(spark, sf_dir):
    rows, owners = _evidence_inputs(spark, sf_dir)
    return attribution.resolve_by_evidence(rows, owners).withColumn("unconfirmed", F.size("unconfirmed"))


_CONFIGURED = f"configured AS (SELECT DISTINCT {key_sql('p_name')} AS key, upper(p_name) AS full FROM part)"
_LIBRARY = f"""{PEOPLE}, spelled AS (SELECT name, {key_sql("alias")} AS key FROM (SELECT name, unnest(aliases) AS alias FROM people)),
    library AS (SELECT key, min(name) AS full, count(DISTINCT name) AS n_names, key IN (SELECT {key_sql("name")} FROM people) AS shadowed
        FROM spelled WHERE key <> '' AND key <> {key_sql("name")} GROUP BY key)"""


def _configured(spark, sf_dir):
    return attribution.configured_aliases(table(spark, sf_dir, "part").select(F.col("p_brand").alias("adapter"), F.col("p_name").alias("alias"), F.upper("p_name").alias("full")))


@query(f"WITH {_CONFIGURED} SELECT * FROM configured")
def alias_pool(spark, sf_dir):
    return _configured(spark, sf_dir)


@query(f"WITH {_LIBRARY} SELECT *, n_names = 1 AND NOT shadowed AS usable FROM library")
def alias_library(spark, sf_dir):
    return attribution.library_aliases(views.people(spark, sf_dir))


@query(f"WITH {_CONFIGURED}, {_LIBRARY} SELECT key, \"full\", 'configured' AS source FROM configured UNION ALL SELECT key, \"full\", 'library' FROM library WHERE n_names = 1 AND NOT shadowed AND key NOT IN (SELECT key FROM configured)")
def alias_pooled(spark, sf_dir):
    return attribution.pooled_aliases(_configured(spark, sf_dir), attribution.library_aliases(views.people(spark, sf_dir)))


def _words(spark, sf_dir):
    """(items, documents) by their words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("words"))
    return items, table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("words"))


@query(
    f"""WITH d AS (SELECT DISTINCT doc_id, unnest({tokens_sql("text")}) AS w FROM documents),
        i AS (SELECT item_id, unnest({tokens_sql("text")}) AS w FROM benchmark),
        n AS (SELECT item_id, count(*) AS size FROM i GROUP BY 1)
        SELECT item_id, doc_id, round(count(*) / size, 6) AS recall, count(*) = size AS contained
        FROM i JOIN d USING (w) JOIN n USING (item_id) GROUP BY item_id, doc_id, size HAVING count(*) >= 0.8 * size"""
)
def token_recall(spark, sf_dir):
    """All documents with four fifths of a benchmark item's words."""
    rows = matching.recall_pairs(*_words(spark, sf_dir), 0.8)
    return rows.select("item_id", "doc_id", F.round("recall", 6).alias("recall"), (F.col("recall") == 1).alias("contained"))


@query()
def ratio_similarity(spark, sf_dir):
    """Matching-blocks ratio of benchmark items to all documents with four fifths of their words, whole texts compared."""
    pairs = written_once(matching.recall_pairs(*_words(spark, sf_dir), 0.8).select("item_id", "doc_id"))
    items = table(spark, sf_dir, "benchmark").select("item_id", normalize(F.col("text")).alias("i"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # few documents are in a pair: only their texts are moved and normalised
    rows = few(pairs).join(docs, "doc_id").join(items, "item_id")
    dealt = rows.repartition(parts_for(docs), "doc_id", "item_id").sortWithinPartitions("doc_id")  # the ratio indexes a text once for a run of rows
    rows = dealt.select("item_id", "doc_id", "i", normalize(F.col("text")).alias("d"))
    return rows.select("item_id", "doc_id", similarity.rounded(similarity.ratio(F.col("i"), F.col("d"))).alias("ratio"))


@query()
def close_texts(spark, sf_dir):
    """All titles, and benchmark items, whose matching-blocks ratio to a part's name and brand is 0.7 or more, whatever words they share."""
    part = table(spark, sf_dir, "part")
    items = part.select(normalize(F.concat_ws(" ", "p_name", "p_brand")).alias("text")).distinct().select(F.xxhash64("text").alias("item_id"), "text")
    titles = part.select(normalize(F.concat_ws(" ", "p_name", "p_type")).alias("text")).union(table(spark, sf_dir, "benchmark").select(normalize(F.col("text")).alias("text"))).distinct()
    return matching.ratio_pairs(items, titles.select(F.xxhash64("text").alias("doc_id"), "text"), 0.7)


@query()
def match_score(spark, sf_dir):
    """Scores of part names as titles for files of the same brand and size."""
    part = table(spark, sf_dir, "part")
    named = part.select("p_partkey", "p_brand", "p_size", F.concat("p_brand", F.lit(" - "), "p_name", F.lit(".mp4")).alias("name"), "p_type")
    titles = part.select("p_brand", "p_size", F.col("p_name").alias("title")).distinct()
    scored = similarity.match_pairs(named, titles, ["p_brand", "p_size"], "p_partkey", "name", "p_type", "title", "p_brand")
    return scored.select("p_partkey", "title", "m.value", "m.contained", "m.meaningful_count")


@query()
def library_scan(spark, sf_dir):
    """The scan end to end: parts as files of makers, that folders or names say, part names as the candidates of three stores."""
    part = views.filed(table(spark, sf_dir, "part"))
    files = part.select(F.col("p_partkey").alias("id"), "name", "folder")
    nobody = spark.createDataFrame([], "key string, full string")
    resolutions = attribution.resolve(files, nobody)
    # creators as the attribution reads them: words with their case
    listing = part.groupBy("maker", "p_name").agg(F.min("p_partkey").alias("idx"))
    found = listing.select(
        F.col("maker").alias("artist"), F.concat(F.lit("store"), (F.col("idx") % 3).cast("string")).alias("store"), (F.col("idx") % 3 > 0).alias("resolvable"), "idx",
        F.col("p_name").alias("title"), F.lit(None).cast("string").alias("url"),
    )
    stores = spark.createDataFrame([("store0", None), ("store1", None), ("store2", "timeout")], "store string, error string")
    fallback = found.limit(0).select(F.lit(0).cast("long").alias("id"), "store", "resolvable", "idx", "title", "url")
    done = linkage.examine(files, resolutions, found, fallback, stores, {})
    return done.select("id", "outcome", "reason", "store", "value", "title")


@query(
    """WITH q AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN 'filtered_out' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'muted'
            WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'already_proposed' ELSE 'selected' END AS reason FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS n FROM q)
        SELECT doc_id, CASE WHEN reason = 'selected' AND n > 100 THEN 'deferred' ELSE reason END AS reason FROM r"""
)
def select_batch(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    picked = selection.select_batch(rows, "doc_id", labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id"), F.col("lang") == "en", 100)
    return picked.select("doc_id", "reason")


@query(
    """WITH q AS (SELECT CASE WHEN lang <> 'en' THEN 'filtered_out' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'muted'
            WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'already_proposed' ELSE 'selected' END AS reason FROM documents)
        SELECT reason, count(*) AS n FROM q GROUP BY 1"""
)
def select_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return selection.tally(selection.classify(rows, "doc_id", labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id"), F.col("lang") == "en"))


@query("SELECT DISTINCT o_custkey AS id, 'whole' AS read FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def gone_sweep(spark, sf_dir):
    """Customers of orders that a listing lacks: swept by a whole listing, not by one that is short by a row or repeats one."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    told = customers.agg(F.count(F.lit(1)).alias("n"))
    last = customers.agg(F.max("id").alias("id"))
    reads = {"whole": customers, "short": customers.join(last, "id", "left_anti"), "repeated": customers.join(last, "id", "left_anti").union(customers.agg(F.min("id")))}
    swept = [selection.gone_sweep(stored, present, told).withColumn("read", F.lit(name)) for name, present in reads.items()]
    return swept[0].union(swept[1]).union(swept[2])


@query("SELECT o_orderkey AS id, o_orderstatus <> 'O' AS added FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'")
def pool_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return selection.pool(orders.where("o_orderstatus = 'O'"), orders.where("o_orderpriority = '1-URGENT'")).select("id", "added")


@query(
    f"""WITH {PEOPLE} SELECT l_orderkey AS subject, max(name) AS name FROM lineitem JOIN people ON people.id = CAST(l_suppkey AS VARCHAR) GROUP BY 1"""
)
def look_up_once(spark, sf_dir):
    folk = views.people(spark, sf_dir).select("id", "name")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_suppkey").cast("string").alias("id"))
    return selection.look_up_once(rows, "id", lambda keys: keys.join(folk, "id")).groupBy("subject").agg(F.max("name").alias("name")).where("name is not null")

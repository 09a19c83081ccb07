"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.class_lm import class_lm_scores
from attesta.llm.conversations import damaged, repaired
from attesta.llm.decontamination import contamination
from attesta.llm.divergence import source_divergence
from attesta.llm.exact_dedup import mark_exact_duplicates
from attesta.llm.html_text import extract_text
from attesta.llm.mixing import mix_sources
from attesta.llm.pieces import encode_pieces
from attesta.llm.simhash import near_duplicates
from attesta.llm.substring_dedup import removal_digest, substring_dedup
from attesta.llm.token_counts import length_histogram, suffix_sums
from attesta.llm.token_files import token_round_trip
from attesta.llm.toxicity import score, train

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(substring_dedup(table(spark, sf_dir, "documents")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("text_sha256", F.sha2("text", 256))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")), copies="copies").drop("repaired")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_pieces(table(spark, sf_dir, "documents"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (
        op1_substring_dedup, op2_simhash_dedup, op3_decontamination, op4_token_files, op5_class_lm, op6_toxicity, op7_token_counts,
        op8_exact_dedup, op9_source_mixing, op10_html_text, op11_conversation_repair, op12_sentencepiece, op13_source_divergence,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": """
            WITH d AS (
                SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
                FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)""",
        "op11_conversation_repair": r"""
            WITH RECURSIVE crc AS (
                SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
            dealt AS (
                SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fate
                FROM conversations, crc),
            damaged AS (
                SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                       unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
            placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
            judged AS (
                SELECT *, substr(role, 1, 1) AS initial, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair,
                       CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                            WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
            facts AS (
                SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                       count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
            ins(q, q1, k, said) AS (
                VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'), (3, 2, 1, chr(10) || 'user:'), (2, 3, 1, chr(10) || 'assistant:'),
                       (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (3, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:')),
            ops(q1, q2, edit, price, initial, as_role) AS (
                VALUES (0, 0, 'D', 4, '', ''), (1, 1, 'D', 4, '', ''), (2, 2, 'D', 4, '', ''), (3, 3, 'D', 4, '', ''), (0, 1, 'K', 0, 's', ''), (0, 2, 'K', 0, 'u', ''), (1, 2, 'K', 0, 'u', ''), (3, 2, 'K', 0, 'u', ''), (2, 3, 'K', 0, 'a', ''),
                       (0, 2, 'R', 3, '', 'user'), (1, 2, 'R', 3, '', 'user'), (3, 2, 'R', 3, '', 'user'), (2, 3, 'R', 3, '', 'assistant')),
            best(conv_id, i, q, cost, audit, lines) AS (
                SELECT conv_id, 0::BIGINT, 0, 0, '', '' FROM (SELECT DISTINCT conv_id FROM conversations)
                UNION ALL
                SELECT conv_id, i, q, cost, audit, lines FROM (
                    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS place FROM (
                        SELECT b.conv_id, j.i, o.q2 AS q, b.cost + 3 * s.k + o.price + CASE WHEN j.fault = 'truncated' AND o.edit <> 'D' THEN 3 ELSE 0 END AS cost,
                               b.audit || repeat('I', s.k) || o.edit AS audit,
                               b.lines || s.said || CASE o.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text ELSE chr(10) || o.as_role || ':' || j.text END AS lines
                        FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1 JOIN ins s ON s.q = b.q JOIN ops o ON o.q1 = s.q1
                        WHERE (o.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (o.edit <> 'K' OR o.initial = j.initial))) WHERE place = 1),
            ended AS (
                SELECT b.conv_id, b.cost + 3 * s.k AS cost, b.audit || repeat('I', s.k) AS audit, substr(b.lines || s.said, 2) AS lines,
                       row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 3 * s.k, b.audit || repeat('I', s.k)) AS place
                FROM best b JOIN ins s ON s.q = b.q AND s.q1 IN (0, 3) LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(f.n, 0))
            SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   CAST(cost AS BIGINT) AS cost, audit, sha256(lines) AS repaired_sha256
            FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id WHERE place = 1""",
        "op13_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            t AS (
                SELECT id, lang, source, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM d),
            kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
            langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
            g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
            f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            totals AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY lang, source),
            p AS (
                SELECT f.lang, f.source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p,
                       1 + (1000000000 * (lang_n + 5)::HUGEINT) // (lang_total + 5 * v)::HUGEINT AS q
                FROM f JOIN totals USING (lang, source) JOIN langs ON langs.lang = f.lang),
            apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            rows_ AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
                FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    }

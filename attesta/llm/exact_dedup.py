"""Exact duplicates of whole texts: a heavy-hitter split in DataFrame and SQL functions only.

A Misra-Gries sketch (Spark's ``approx_top_k``) proposes digests that fill many rows. Their exact sizes and
keepers are counted, which gives a table of at most ``heavy`` rows (plus hash namesakes): it is broadcast and
settles those rows map-side. All other digests are counted with map-side combining and joined back by an ordinary
shuffle, so no task holds a group.

Defined results: a null text counts as empty; a null doc_id never stays before another id and a group of
null ids only has a null keep_id; rows that repeat the keeper's doc_id are all marked kept (``drop_exact_duplicates``
leaves one of them); an empty table gives no rows; columns other than the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import ascii_lower, fresh, persist

#: Digests proposed by the sketch, and counters it keeps.
HEAVY, COUNTERS = 128, 8192


def mark_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = persist(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest")))
    keyed = rows.withColumn("short", F.xxhash64("digest"))
    proposed = keyed.agg(F.expr(f"approx_top_k(short, {heavy}, {counters})").alias("top")).select(F.explode("top.item").alias("short"))
    winners = (
        keyed.join(F.broadcast(proposed), "short", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    split = rows.join(F.broadcast(winners), "digest", "left")
    loose = split.where(F.col("group_size").isNull()).select("doc_id", "digest")
    sizes = loose.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))  # combined map-side
    rest = loose.join(sizes, "digest").select("doc_id", "digest", "keep_id", "group_size")
    done = split.where(F.col("group_size").isNotNull()).select("doc_id", "digest", "keep_id", "group_size").unionByName(rest)
    return done.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat the kept doc_id and text, one."""
    keep, digest = fresh(docs, "__keep", "__digest")
    kept = mark_exact_duplicates(docs, doc_id, text).where("kept").select(F.col("doc_id").alias(keep), F.unhex("text_sha256").alias(digest)).distinct()
    own = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text], F.lit(""))), 256))
    joined = docs.join(kept, docs[doc_id].eqNullSafe(kept[keep]) & (own == kept[digest]), "inner")
    return joined.dropDuplicates([keep, digest]).drop(keep, digest)

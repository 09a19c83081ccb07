"""Exact token counts: a histogram of encoded lengths answers every total by suffix sums.

Each task encodes its whole documents and returns one row per distinct length; lengths are then summed.
For a context limit L, documents of at least L tokens give L each and shorter ones their own length, so the
truncated total for *every* L follows from suffix sums over the histogram, as do quantiles.

Defined results: a null text has length 0; an empty table gives no rows; rows that repeat are counted one by one,
whatever their ids; only the text column is read. The suffix sums run within ranges of ``SPAN`` lengths (a range has
at most that many rows, however many documents there are), then over one row per range.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import bounded, lean, persist
from attesta.llm.units import encoder, tokenizer_json

SPAN = 1024


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    spec = tokenizer_json(tokenizer)
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = encoder(spec), Counter()
        for batch in batches:
            found.update(len(x) // own.dtype.itemsize for x in own.encode_many([x or "" for x in batch.column(0).to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    lengths = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run, "encoder"), "n_tokens long, n_docs long")
    return persist(lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))  # suffix_sums reads it twice


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens at or above it, and the truncated total.

    Columns: n_tokens, n_docs, docs_from, tokens_from, docs_all, tokens_all, truncated_total (tokens kept if every
    document is cut to n_tokens), share_below (share of documents that are shorter).
    """
    rows = histogram.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of SPAN lengths: the longest document's length / SPAN rows, whatever the number of documents
    spans = rows.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = spans.agg(F.sum("d").alias("docs_all"), F.sum("t").alias("tokens_all"))
    spans = spans.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    return (
        rows.join(spans, "span")
        .join(F.broadcast(every))  # a single row
        .withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("d_after"))
        .withColumn("tokens_from", F.sum("tokens").over(inside) + F.col("t_after"))
        .select(
            "n_tokens", "n_docs", "docs_from", "tokens_from", "docs_all", "tokens_all",
            (F.col("tokens_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
            ((F.col("docs_all") - F.col("docs_from")) / F.col("docs_all")).alias("share_below"),
        )
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of documents do not exceed."""
    upto = F.col("docs_all") - F.col("docs_from") + F.col("n_docs")
    return sums.where(upto >= F.lit(q) * F.col("docs_all")).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept if every document is cut to any ``limit``, whether or not a document has that length."""
    below = F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("n_docs"))), F.lit(0))
    above = F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0))
    return sums.agg((below + limit * above).alias("truncated_total"))

"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of every ``window`` consecutive ``k``-word grams, so any span of
``k + window - 1`` words that they share has a fingerprint in common. Training fingerprints are joined to the
test fingerprints, and every hit is extended to the windows of that length around it, each compared word by word; those
that match are exactly the occurrences of test windows. Items shorter than a window are one window of their own
length and are looked up by the hash of that many words.

The test fingerprints are broadcast in blocks of at most ``TEST_BYTES`` of item text, a checked bound: a
larger benchmark takes several passes, whose spans are merged per document.

Defined results: words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z; a
null or empty text has no words and is never contaminated, a null or wordless item occurs nowhere; a null
item_id is listed as the empty string; rows that repeat an item_id are one item; rows that repeat a doc_id are
judged one by one; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, Hashes, bounded, encode, grouped, lean, slices, small_batches, texts_of

#: Words of a gram and grams of a window: every shared span of K + WINDOW - 1 = 13 words is found.
K, WINDOW = 5, 9
#: Text of the items of one broadcast block.
TEST_BYTES = 16 << 20
#: Text that is judged at once.
SLICE_BYTES = 2 << 20
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20
_KEEP = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)
_BETWEEN = b"\x00"  # not a word, so no span crosses documents
_BASE = 0x9E3779B97F4A7C15

SPANS = "doc_id long, text_hash binary, n_words long, spans array<struct<first: long, last: long>>, item_ids array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(_BASE), np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * base + hashes[j : j + len(out)]
    return out ^ (out >> np.uint64(29))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` consecutive values, in log2(width) passes."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the minimum of at least one window (all of them, if minima tie)."""
    if len(values) <= window:
        return np.flatnonzero(values == values.min()) if len(values) else np.zeros(0, np.int64)
    low = _slide(values, window, np.minimum)
    pad = np.zeros(window - 1, values.dtype)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), window, np.maximum) == values)


class TestIndex:
    """Fingerprints of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], k: int = K, window: int = WINDOW):
        self.k, self.window, self.least = k, window, k + window - 1
        self.ids, self.words = [], []
        keys, full, places = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        hashes = Hashes()
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            at, h = len(self.ids), hashes.of(words)
            self.ids.append(item_id)
            self.words.append(words)
            if len(words) < self.least:
                self.short.setdefault(len(words), {}).setdefault(int(grams(h, len(words))[0]), []).append(at)
            else:
                g = grams(h, k)
                keys.append(np.unique(g[winnow(g, window)]))
                # every window of 13 words, the first of equal ones of an item
                own, first = np.unique(grams(h, self.least), return_index=True)
                full.append(own)
                places.append(np.stack([np.full(len(own), at), first]).astype(np.int32))
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        every, at = (np.concatenate(full), np.concatenate(places, axis=1)) if full else (np.zeros(0, np.uint64), np.zeros((2, 0), np.int32))
        order = np.argsort(every, kind="stable")
        self.full, self.places = every[order], at[:, order]
        self.short_keys = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}

    @staticmethod
    def _found(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(values):
            return np.zeros(0, np.int64)
        at = np.searchsorted(keys, values)
        at[at == len(keys)] = 0
        return np.flatnonzero(keys[at] == values)

    def spans(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, end, item) of every window of an item that occurs in a run of words.

        A window that is shared has a winnowed gram in common, so only those around a hit are looked at: each start once, whatever
        the number of equal grams on either side.
        """
        g = grams(hashes, self.k)
        chosen = winnow(g, self.window)
        hits = chosen[self._found(g[chosen], self.keys)]
        if len(hits):
            starts = np.unique((hits[:, None] - np.arange(self.least - self.k + 1)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - self.least)]
            asked = grams(hashes, self.least)[starts]
            low, high = (np.searchsorted(self.full, asked, side) for side in ("left", "right"))
            for s in np.flatnonzero(high > low).tolist():
                p = int(starts[s])
                own = words[p : p + self.least]
                for item, q in self.places[:, low[s] : high[s]].T.tolist():
                    if self.words[item][q : q + self.least] == own:
                        yield p, p + self.least, item
        for n, keys in self.short_keys.items():
            g = grams(hashes, n)
            for p in self._found(g, keys).tolist():
                for item in self.short[n][int(g[p])]:
                    if words[p : p + n] == self.words[item]:
                        yield p, p + n, item


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judge(texts: list[bytes], index: TestIndex, hashes: Hashes) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(n_words, merged spans as (first, end), item ids sorted as strings) of each text."""
    every: list[bytes] = []
    starts, counts = [], []
    for text in texts:
        words = words_of(text)
        starts.append(len(every))
        counts.append(len(words))
        every += words
        every.append(_BETWEEN)
    spans: list[list] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for a, b, item in index.spans(every, hashes.of(every)):
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans[d].append((a - starts[d], b - starts[d]))
        items[d].add(index.ids[item])
    return [(n, _merged(s), sorted(i)) for n, s, i in zip(counts, spans, items, strict=True)]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())


def _block_numbers(benchmark: DataFrame, item_id: str, text: str, most: int) -> range:
    size = _items(benchmark, item_id, text).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return range(max(1, -(-size // most)))


def test_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = TEST_BYTES) -> Iterator[TestIndex]:
    """Indexes over all items, each of about ``most`` bytes of text at most (a single larger item apart)."""
    items = _items(benchmark, item_id, text)
    n = len(_block_numbers(benchmark, item_id, text, most))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield TestIndex(sorted((r["id"], encode(r["text"])) for r in own.collect()))


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", test_bytes: int = TEST_BYTES,
    keep_hash: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (word positions, both ends included), item_ids."""
    spark = docs.sparkSession
    passes = []
    apart = keep_hash or len(_block_numbers(benchmark, item_id, item_text, test_bytes)) > 1
    for index in test_blocks(benchmark, item_id, item_text, test_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, hashes = sent.value, Hashes()
            for batch in batches:
                ids, texts = batch.column(0), texts_of(batch.column(1))
                for own in slices(texts, SLICE_BYTES):
                    found = judge(texts[own], index, hashes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids[own.start : own.stop], batch.column(2)[own.start : own.stop], pa.array([x[0] for x in found], pa.int64()),
                            pa.array([[{"first": a, "last": b - 1} for a, b in x[1]] for x in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                            pa.array([x[2] for x in found], pa.list_(pa.string())),
                        ],
                        ["doc_id", "text_hash", "n_words", "spans", "item_ids"],
                    )

        # the digest tells texts apart where passes are merged or rows are dropped by it
        rows = small_batches(docs, doc_id, text).withColumn("text_hash", F.unhex(F.sha2("text", 256)) if apart else F.lit(None).cast("binary"))
        passes.append(rows.mapInArrow(lean(run), SPANS))
    if len(passes) == 1:
        return passes[0] if keep_hash else passes[0].drop("text_hash")
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    # equal (doc_id, text) rows have equal results, so a group is one document, repeated once per row and pass
    merged = every.groupBy("doc_id", "text_hash", "n_words").agg(
        F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.count(F.lit(1)).alias("n")
    )

    @F.udf("array<struct<first: long, last: long>>")
    def joined(lists):
        return [(a, b - 1) for a, b in _merged([(x["first"], x["last"] + 1) for one in lists for x in one])]

    repeat = F.explode(F.sequence(F.lit(1), (F.col("n") / len(passes)).cast("int")))
    rows = merged.select("doc_id", "text_hash", "n_words", joined("spans").alias("spans"), "item_ids", repeat.alias("__row")).drop("__row")
    return rows if keep_hash else rows.drop("text_hash")


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """benchmark_spans plus n_hit, n_items and contaminated (at least one word in SHARE hit)."""
    n_hit = hit_words(F.col("spans"))
    rows = benchmark_spans(docs, benchmark, **names).withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", test_bytes: int = TEST_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and no shuffle.

    With more than one block of items, ``docs`` is first joined with each document's merged spans.
    """
    bounded(docs.sparkSession)
    blocks = list(islice(test_blocks(benchmark, item_id, item_text, test_bytes), 2))
    if len(blocks) > 1:
        judged = contamination(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")).distinct(), benchmark, item_id=item_id, item_text=item_text, test_bytes=test_bytes, keep_hash=True)
        bad = judged.where("contaminated").select(F.col("text_hash").alias("bad_text")).distinct()
        return docs.join(bad, F.unhex(F.sha2(docs[text].cast("string"), 256)) == bad["bad_text"], "left_anti")
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            texts, keep = texts_of(batch.column(at)), []
            for own in slices(texts, SLICE_BYTES):
                keep += [not (hit and SHARE * hit >= n) for n, hit in ((n, sum(b - a for a, b in s)) for n, s, _ in judge(texts[own], sent.value, hashes))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return grouped(docs).mapInArrow(lean(run), docs.schema)

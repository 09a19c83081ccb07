"""Source divergence audit: which sources of a language use its terms differently, and by which terms.

Sketch-prefiltered counting in two passes over the documents. The first makes a count-min sketch of document frequencies of
(language, term): each task has its own, cells saturate at a small integer, slices of all sketches are added in order, and the
merged sketch (at most ``MOST_CELLS`` one-byte cells a row, so its size is bounded whatever the input) is broadcast. It never
underestimates, so a term below the threshold in it can't be frequent enough and is discarded by the second pass before any
row is made; survivors are counted exactly, combined in each task and then by an ordinary shuffle. The sketch is wider for
larger inputs; beyond its largest width it discards less, and the counts stay the same.

Distances of sources are sums over all terms kept, though a source holds few of them: with p0 the value of a term that a
source does not hold, each pair starts from V * |p0 - p0'| and gets corrections for the terms of either and of both. Terms are
dealt into buckets by hash, and each bucket gives one partial sum for a pair of sources, not a row for each term and pair, so a term that all
sources share makes no more rows than another. (The result itself has a row for each ordered pair of a language's sources.)

Defined results: null texts, languages and sources are empty strings; a document without terms still makes its (language,
source) occur; rows that repeat, and equal doc_ids, count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import _estimate, bounded, lean, persist, texts_of

#: Documents of its language that a term must stand in; ranks of terms that are reported; scale of values and prior of counts.
MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Rows of the sketch, cells of a row at least and at most, cells of a slice.
DEPTH, FEWEST_CELLS, MOST_CELLS, SLICE = 3, 1 << 16, 1 << 24, 1 << 18
#: Text of a chunk that is counted at once, terms and counts a task holds before it gives them out, rows of a bucket of terms.
CHUNK_BYTES, HELD_TERMS, HELD_COUNTS, BUCKET_ROWS = 8 << 20, 400_000, 4_000_000, 200_000
#: bytes.translate table: ASCII letters lower-cased, other ASCII a space; all bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def width(size: int) -> int:
    """Cells of a sketch row for a table of so many bytes as Spark estimates it: a power of two near a cell for 64 bytes."""
    return min(MOST_CELLS, max(FEWEST_CELLS, 1 << (size // 64).bit_length()))


class Sketch:
    """Count-min rows of saturating cells."""

    def __init__(self, cells: int, most: int, rows: np.ndarray | None = None):
        kind = np.uint8 if most <= 255 else np.uint16 if most <= 65535 else np.uint32
        self.top = np.iinfo(kind).max
        self.rows = np.zeros((DEPTH, cells), kind) if rows is None else rows
        self.mask = np.uint64(cells - 1)

    def _cells(self, lang: bytes, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seed = xxhash.xxh3_64_intdigest(lang)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        step = h >> np.uint64(32) | np.uint64(1)
        for j in range(DEPTH):
            yield self.rows[j], (h + np.uint64(j) * step) & self.mask

    def add(self, lang: bytes, counts: Counter) -> None:
        many = np.fromiter(counts.values(), np.int64, len(counts))
        for row, at in self._cells(lang, list(counts)):
            order = np.argsort(at, kind="stable")
            cells, starts = np.unique(at[order], return_index=True)
            row[cells] = np.minimum(row[cells] + np.add.reduceat(many[order], starts), self.top)

    def at_least(self, lang: bytes, words: list[bytes], least: int) -> np.ndarray:
        """Whether each word may stand in ``least`` documents."""
        out = np.ones(len(words), bool)
        for row, at in self._cells(lang, words):
            out &= row[at] >= least
        return out

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """(number, packed cells) of the slices that are not all zero."""
        flat = self.rows.reshape(-1)
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(0, len(flat), SLICE):
            if flat[k : k + SLICE].any():
                yield k // SLICE, pack.compress(flat[k : k + SLICE].tobytes())


def _plain(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    bounded(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes, bytes]]]:
    """(lang, source, text) rows in lists of about CHUNK_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(texts_of(batch.column(k)) for k in range(3)), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def sketch(docs: DataFrame, cells: int, min_docs: int = MIN_DOCS) -> Sketch:
    """The merged sketch of document frequencies of (lang, term); ``docs`` has lang, source, text without nulls."""
    spark = docs.sparkSession
    # few tasks with much text each, so that sketches are small against what they count
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(1 << 20, _estimate(docs) // (64 * DEPTH * cells)))
    few = docs.coalesce(tasks)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(cells, min_docs)
        for chunk in _chunks(batches):
            found: dict[bytes, Counter] = defaultdict(Counter)
            for lang, _, text in chunk:
                found[lang].update(set(terms(text)))
            for lang, counts in found.items():
                own.add(lang, counts)
        for k, cells_ in own.slices():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "cells": pa.array([cells_], pa.binary())})

    kind = Sketch(1, min_docs).rows.dtype

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(k: int, total: np.ndarray) -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
            return pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "cells": pa.array([packed], pa.binary())})

        at, total, top = None, None, np.iinfo(kind).max
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells_ = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind).astype(np.int64)
                if k != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = k, cells_.astype(kind)
                else:
                    total = np.minimum(total + cells_, top).astype(kind)
        if at is not None:
            yield row(at, total)

    schema = "slice int, cells binary"
    merged = few.mapInArrow(lean(fill), schema).repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(add), schema)
    out = Sketch(cells, min_docs)
    flat = out.rows.reshape(-1)
    for r in merged.collect():  # at most DEPTH * MOST_CELLS / SLICE rows of SLICE cells
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["cells"])), kind)
        flat[r["slice"] * SLICE :][: len(part)] = part
    return out


class _Tally:
    """Exact counts of a language's terms in a task, by source, as arrays over the terms that the sketch does not rule out."""

    def __init__(self, lang: bytes):
        self.lang = lang
        self.ids: dict[bytes, int] = {}  # term -> place among ``words``; -1 if ruled out
        self.words: list[bytes] = []
        self.n: dict[bytes, np.ndarray] = {}
        self.docs: dict[bytes, np.ndarray] = {}

    def add(self, rows: list[tuple[bytes, list[bytes]]], found: Sketch, min_docs: int) -> None:
        """Counts (source, terms) of documents."""
        kinds = [set(words) for _, words in rows]
        new = list(set().union(*kinds) - self.ids.keys())
        for word, ok in zip(new, found.at_least(self.lang, new, min_docs).tolist(), strict=True):
            self.ids[word] = len(self.words) if ok else -1
            if ok:
                self.words.append(word)
        place = self.ids.__getitem__
        each: dict[bytes, tuple[list[np.ndarray], list[np.ndarray]]] = defaultdict(lambda: ([], []))
        for (source, words), own in zip(rows, kinds, strict=True):
            n, docs = each[source]
            n.append(np.fromiter(map(place, words), np.int32, len(words)))
            docs.append(np.fromiter(map(place, own), np.int32, len(own)))
        for source, parts in each.items():
            for held, some in zip((self.n, self.docs), parts, strict=True):
                at = np.concatenate(some)
                more = np.bincount(at[at >= 0], minlength=len(self.words))
                if source in held:
                    more[: len(held[source])] += held[source]
                held[source] = more

    def given(self) -> Iterator[pa.RecordBatch]:
        """A row for each source and term that it holds."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        name = lambda x, k: pa.array([x], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(k, np.int64)))
        for source, n in self.n.items():
            some = np.flatnonzero(n)
            for k in range(0, len(some), 50_000):
                at = some[k : k + 50_000]
                columns = [name(self.lang, len(at)), name(source, len(at)), words.take(pa.array(at)), pa.array(n[at]), pa.array(self.docs[source][at])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, found: Sketch, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, docs) of terms that the sketch does not rule out: occurrences and documents; a row with a null term for each (lang, source)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((found.rows.shape[1], found.rows.tobytes(), found.rows.dtype.str))
    schema = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, raw, kind = shared.value
        tallies: dict[bytes, _Tally] = {}
        own = Sketch(cells, min_docs, np.frombuffer(raw, kind).reshape(DEPTH, cells))
        occurring: set[tuple[bytes, bytes]] = set()
        for chunk in _chunks(batches):
            by_lang: dict[bytes, list[tuple[bytes, list[bytes]]]] = defaultdict(list)
            for lang, source, text in chunk:
                occurring.add((lang, source))
                by_lang[lang].append((source, terms(text)))
            for lang, rows in by_lang.items():
                tallies.setdefault(lang, _Tally(lang)).add(rows, own, min_docs)
            if sum(len(t.ids) for t in tallies.values()) >= HELD_TERMS or sum(map(len, (x for t in tallies.values() for x in t.n.values()))) >= HELD_COUNTS:
                for t in tallies.values():
                    yield from t.given()
                tallies.clear()
        for t in tallies.values():
            yield from t.given()
        if occurring:
            groups = sorted(occurring)
            columns = [pa.array([g[i] for g in groups], pa.binary()).cast(pa.string()) for i in (0, 1)]
            empty = pa.array([0] * len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(groups), pa.string()), empty, empty], ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(lean(count), schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _value(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kinds)), exactly."""
    above = (count.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + kinds * PRIOR).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Corrections to V * |p0 - p0'| from one bucket of terms, for each pair a < b of the language's sources."""
    lang = right.column("of")[0].as_py()
    names = right.column("name").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode("utf-8", "surrogatepass"))
    names = [names[i] for i in order]
    p0 = right.column("base").to_numpy()[order].astype(np.int64)
    place = {x: k for k, x in enumerate(names)}
    s = np.array([place[x] for x in left.column("source").to_pylist()], np.int64)
    p = left.column("p").to_numpy().astype(np.int64)
    coded = left.column("term").combine_chunks().dictionary_encode()
    t = np.asarray((coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices).astype(np.int64)
    n = len(names)
    sums = np.zeros((n, n), np.int64)
    apart = np.abs(p0[:, None] - p0[None, :])
    for g in np.unique(s).tolist():  # terms of g against p0 of each other: sorted once, then by running sums
        own = np.sort(p[s == g])
        upto = np.concatenate([[0], np.cumsum(own)])
        at = np.searchsorted(own, p0)
        sums[g] += p0 * at - upto[at] + (upto[-1] - upto[at]) - p0 * (len(own) - at) - len(own) * apart[g]
    sums += sums.T.copy()
    by = np.lexsort((s, t))
    s, t, p = s[by], t[by], p[by]
    for k in range(1, n):  # terms of both: k-th next source of the same term
        same = np.flatnonzero(t[k:] == t[:-k]) if k < len(t) else np.zeros(0, np.int64)
        if not len(same):
            break
        a, b, pa_, pb = s[same], s[same + k], p[same], p[same + k]
        np.add.at(sums, (a, b), np.abs(pa_ - pb) - np.abs(pa_ - p0[b]) - np.abs(pb - p0[a]) + apart[a, b])
    a, b = np.triu_indices(n, 1)
    columns = [pa.array([lang] * len(a), pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(sums[a, b], pa.int64())]
    return pa.Table.from_arrays(columns, ["lang", "a", "b", "value"])


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, cells: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the language's other sources, part ``term`` the terms that a source uses more than its language."""
    plain = _plain(docs, text, lang, source)
    found = sketch(plain, cells or width(_estimate(plain)), min_docs)
    counts = persist(term_counts(plain, found, min_docs))
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    held = persist(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    zero = F.lit(0).cast("long")
    # one row per (lang, source)
    groups = persist(
        counts.where(F.col("term").isNull())
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "rows", "kinds", "lang_total")])
        .withColumn("p0", F.when(F.col("kinds") > 0, _value(zero, F.col("total"), F.col("kinds"))).otherwise(zero))
    )
    valued = held.join(groups, ["lang", "source"]).withColumn("p", _value(F.col("n"), F.col("total"), F.col("kinds")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (
        valued.withColumn("value", F.col("p") - _value(F.col("lang_n"), F.col("lang_total"), F.col("kinds")))
        .where("value > 0")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    buckets = max(1, -(-(groups.agg(F.sum("rows")).first()[0] or 0) // bucket_rows))
    left = valued.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "source", "term", "p")
    right = groups.where("kinds > 0").select(F.col("lang").alias("of"), F.explode(F.sequence(zero, F.lit(buckets - 1).cast("long"))).alias("in"), F.col("source").alias("name"), F.col("p0").alias("base"))
    sums = left.groupBy("lang", "bucket").cogroup(right.groupBy("of", "in")).applyInArrow(lean(_pair_sums), "lang string, a string, b string, value long")
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    both = summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "more").unionByName(summed.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "more"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"))
    # a row for each ordered pair of sources of a language is the result itself
    pairs = (
        groups.select("lang", "source", "kinds", "p0")
        .join(other, "lang")
        .where(F.col("source") != F.col("item"))
        .join(both, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("kinds") * F.abs(F.col("p0") - F.col("item_p0")) + F.coalesce("more", zero)).alias("value"))
        .withColumn("rank", F.row_number().over(best))
    )
    return pairs.unionByName(over)

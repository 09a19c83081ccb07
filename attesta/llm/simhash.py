"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into two 32-bit segments, each with a table of its values. If two fingerprints differ in at
most two bits, either their first segments differ in at most one bit, or their second segments are equal. So each
fingerprint enumerates the Hamming ball of radius 1 around its first segment and radius 0 around its second,
fetches what the tables hold there, and verifies complete distances. A ball of radius 1 reaches from either side;
only the larger neighbour is enumerated.

Equal fingerprints are one table entry, so copies cost nothing. A table slot that holds more than ``SLOT_PAIRS``
comparisons is not compared pair by pair: its fingerprints enumerate the ball around the other segment too and
look up complete fingerprints, which bounds the work for each by a constant and loses no link.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; rows that
repeat a doc_id are judged by their own fingerprints; a row whose doc_id is null gets the component of its fingerprint's other rows, else null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, grouped, lean, persist, small_batches, texts_of
from attesta.llm.components import Forest, components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Comparisons of one table slot that are made directly.
SLOT_PAIRS = 1 << 23
#: Rows of a table slot that may come together in one task.
SLOT_ROWS = 50_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hash of each word shingle of a text, big-endian; a shorter text is one shingle, one without words none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[min(shingle, len(words)) - 1 :] - 1).tolist(), strict=True)])
    return np.frombuffer(raw, ">u8")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Big-endian fingerprint of a text."""
    rows = shingle_hashes(text, shingle, seed).view(np.uint8).reshape(-1, 8)
    n = len(rows)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        count += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n).tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(x) for x in texts_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return small_batches(docs, doc_id, text).mapInArrow(lean(run), "doc_id long, fp long")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table entries (probe 0) and probes (probe 1) of each fingerprint. slot: the segment's value, or its complement for the second."""
    one = np.uint64(1)
    bits = one << np.arange(32, dtype=np.uint64)
    for batch in batches:
        fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for a in range(0, len(fp), 1 << 14):
            f, n = fp[a : a + (1 << 14)], node[a : a + (1 << 14)]
            high, low = f.view(np.uint64) >> np.uint64(32), f.view(np.uint64) & np.uint64(0xFFFFFFFF)
            who, bit = np.nonzero((high[:, None] & bits) == 0)
            slot = np.concatenate([high, ~low, high[who] | bits[bit]]).view(np.int64)
            pick = np.concatenate([np.arange(len(f)), np.arange(len(f)), who])
            probe = np.repeat(np.array([0, 1], np.int8), [2 * len(f), len(who)])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(probe), pa.array(f[pick]), pa.array(n[pick])], ["slot", "probe", "fp", "node"])


def _compare(most_bits: int):
    """Links of each slot, thinned to a spanning forest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps, nodes, probes in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                fp, probe, forest = np.array(fps, np.int64).view(np.uint64), np.array(probes) == 1, Forest()
                own = np.flatnonzero(~probe)
                for i in own.tolist():
                    near = np.bitwise_count(fp ^ fp[i]) <= most_bits
                    near[own[own <= i]] = False
                    for j in np.flatnonzero(near).tolist():
                        if forest.link(i, j):
                            a.append(nodes[i])
                            b.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete fingerprints to look up for rows of crowded slots: (fp, node) per neighbour."""
    single = [1 << i for i in range(32)]
    double = np.array(single + [x | y for x, y in combinations(single, 2)], np.uint64)
    none = np.array([0, *single], np.uint64)
    for batch in batches:
        slots, probes, fps, nodes = (batch.column(i).to_pylist() for i in range(4))
        for slot, probe, fp, node in zip(slots, probes, fps, nodes, strict=True):
            full = np.array([fp], np.int64).view(np.uint64)[0]
            if probe:
                found = (np.uint64(slot) << np.uint64(32) | full & np.uint64(0xFFFFFFFF)) ^ none
            else:
                found = full ^ (double if slot >= 0 else double << np.uint64(32))
                found = found[found > full]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), node, np.int64))], ["fp", "b"])


def links(nodes: DataFrame, slot_pairs: int = SLOT_PAIRS) -> DataFrame:
    """(a, b): edges that connect the nodes of all fingerprints within MOST_BITS of each other. ``nodes``: distinct (fp, node)."""
    slots = nodes.select("fp", "node").mapInArrow(lean(_slots), "slot long, probe byte, fp long, node long")
    entries, probes = F.sum(1 - F.col("probe")), F.sum("probe")
    sizes = slots.groupBy("slot").agg(entries.alias("e"), probes.alias("p")).where("e >= 2 or (e = 1 and p >= 1)")
    held = persist(grouped(slots.join(sizes, "slot"), nodes))
    crowded = (F.col("e") * (F.col("e") + F.col("p")) > slot_pairs) | (F.col("e") + F.col("p") > SLOT_ROWS)
    near = (
        held.where(~crowded)
        .groupBy("slot")
        .agg(F.collect_list(F.struct("fp", "node", "probe")).alias("rows"))
        .select("rows.fp", "rows.node", "rows.probe")
        .mapInArrow(lean(_compare(MOST_BITS)), "a long, b long")
    )
    far = held.where(crowded).select("slot", "probe", "fp", "node").mapInArrow(lean(_balls), "fp long, b long")
    return near.unionByName(far.join(nodes.select("fp", F.col("node").alias("a")), "fp").select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable over links, its own included)."""
    rows = persist(fingerprints(docs, doc_id, text))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("node"))
    known = distinct.where(F.col("node").isNotNull())
    roots = components(links(known))
    labels = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")

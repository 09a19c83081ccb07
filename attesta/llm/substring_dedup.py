"""Substring deduplication: windows of words that already start in an earlier document are removed.

1. Documents are packed into blocks by doc_id range, so block order is document order.
2. Each block computes the Rabin-Karp hash of every window (polynomial over 64-bit word hashes) and sends its
   distinct hashes, sorted and grouped by hash range, as compressed arrays: a window that occurs in a third of
   all documents is one entry per block, so no key is hot.
3. Each hash range is counted over blocks: one bit per entry says whether an earlier block holds the hash.
4. The bits return to their block, which recomputes its windows, adds repeats between its own documents, and
   merges the repeated windows into maximal removal intervals.

Windows are equal if both of their hashes are, 64 bits that place them and 32 bits of another polynomial: among N
distinct windows N**2 / 2**97 are expected to collide (0.002 for the 2 * 10**13 windows of 100 TB of text). Words
are told apart by 64 bits.

Defined results: words are maximal runs without ASCII white space, unchanged; a null or short text has no
window and loses nothing; equal doc_ids do not remove from each other; a null doc_id counts as the smallest;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BLOCK_BYTES, Hashes, bucket_of, from_delta, in_block, lean, packed_ranges, sorted_delta

WINDOW = 13
_BASE, _CHECK_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_NULL_ID = -(2**63)


def window_hashes(hashes: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive word hashes, mixed so that its high bits are even."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for j in range(width):
        out *= base
        out += hashes[j : j + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(28))


def equal_groups(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by both, whether each in that order is the first of its equals)."""
    order = np.argsort(hashes, kind="stable")
    a, b = hashes[order], checks[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one hash of different windows
        order = np.lexsort((checks, hashes))
        a, b = hashes[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


class Block:
    """Words and windows of a block's documents, in (doc_id, text) order."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, texts = in_block(list(zip(*(table.column(c).to_pylist() for c in ("ids", "ends", "body")), strict=True)))
        self.words: list[bytes] = []
        ends = []
        for text in texts:
            self.words += text.split()
            ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        self.doc = np.repeat(np.arange(len(ends)), np.diff(self.ends, prepend=0))
        words = Hashes().of(self.words)
        every = window_hashes(words, width)
        self.starts = np.flatnonzero(self.doc[: len(every)] == self.doc[width - 1 :]) if len(every) else np.zeros(0, np.int64)
        self.hashes = every[self.starts]
        self.checks = (window_hashes(words, width, _CHECK_BASE)[self.starts] >> np.uint64(32)).astype("<u4")


def _emit(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        held = Block(table, width)
        order, new = equal_groups(held.hashes, held.checks)
        own, checks = held.hashes[order[new]], held.checks[order[new]]
        cuts = np.searchsorted(bucket_of(own, buckets), np.arange(buckets + 1, dtype=np.uint64))
        rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([x[0] for x in rows], pa.int64()),
                "block": pa.array([block] * len(rows), pa.int64()),
                "hashes": pa.array([sorted_delta(own[a:b]) for _, a, b in rows], pa.binary()),
                "checks": pa.array([checks[a:b].tobytes() for _, a, b in rows], pa.binary()),
            }
        )

    return run


def _count(table: pa.Table) -> pa.Table:
    """For each block's entries of a hash range: bits that say whether an earlier block has the hash."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "hashes", "checks")), strict=True))
    arrays = [from_delta(x[1]) for x in rows]
    order, new = equal_groups(np.concatenate(arrays), np.concatenate([np.frombuffer(x[2], "<u4") for x in rows]))
    again = np.zeros(len(order), bool)
    again[order] = ~new  # blocks are in order, so the first of equals is the earliest
    out, at = [], 0
    for (block, _, _), own in zip(rows, arrays, strict=True):
        bits = again[at : at + len(own)]
        at += len(own)
        if bits.any():
            out.append((block, np.packbits(bits).tobytes()))
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "block": pa.array([x[0] for x in out], pa.int64()),
            "bucket": pa.array([bucket] * len(out), pa.int64()),
            "bits": pa.array([zstandard.ZstdCompressor(level=1).compress(x[1]) for x in out], pa.binary()),
        }
    )


def covered(block: Block, replies: dict[int, bytes], width: int, buckets: int) -> np.ndarray:
    """Which words lie in a window that starts in a document with a smaller doc_id."""
    order, new = equal_groups(block.hashes, block.checks)
    group = np.cumsum(new) - 1
    own = block.hashes[order[new]]
    foreign = np.zeros(len(own), bool)
    if replies:
        cuts = np.searchsorted(bucket_of(own, buckets), np.arange(buckets + 1, dtype=np.uint64))
        for bucket, bits in replies.items():
            a, b = int(cuts[bucket]), int(cuts[bucket + 1])
            foreign[a:b] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8), count=b - a)
    ids = block.ids[block.doc[block.starts[order]]]
    again = foreign[group] | (ids > ids[np.flatnonzero(new)][group])
    starts = block.starts[order[again]]
    steps = np.zeros(len(block.words) + 1, np.int32)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps)[:-1] > 0


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept_text string"


def _apply(width: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, width)
        gone = covered(block, dict(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True)), width, buckets)
        edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        spans: list[list] = [[] for _ in block.ids]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            d, e = int(block.doc[a]), int(block.doc[b])
            while d < e:  # an interval of words may touch the next document's
                end = int(block.ends[d])
                if end > a:
                    spans[d].append((a, end - 1))
                    a = end
                d += 1
            spans[d].append((a, b))
        texts, removed, begin = [], [], 0
        keep = ~gone
        for d, end in enumerate(block.ends.tolist()):
            words = block.words[begin:end]
            texts.append(b" ".join(compress(words, keep[begin:end].tolist()) if spans[d] else words))
            removed.append(sum(b - a + 1 for a, b in spans[d]))
            spans[d] = [{"first": a - begin, "last": b - begin} for a, b in spans[d]]
            begin = end
        return pa.table(
            {
                "doc_id": pa.array(block.ids, mask=block.ids == _NULL_ID),
                "n_words": pa.array(np.diff(block.ends, prepend=0), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (removed word positions, both ends included), kept_text."""
    packed, n = packed_ranges(docs, doc_id, text, block_bytes)
    buckets = min(4 * n, 4096 + n // 8)
    windows = packed.groupBy("block").applyInArrow(lean(_emit(width, buckets)), "bucket long, block long, hashes binary, checks binary")
    bits = windows.groupBy("bucket").applyInArrow(lean(_count), "block long, bucket long, bits binary")
    return packed.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(lean(_apply(width, buckets)), RESULT)


def removal_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

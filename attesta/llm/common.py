"""Shared pieces of the corpus operators: shared-folder access, sizing, packed document blocks.

Large operators move *blocks* (some thousands of documents as one compressed binary row) instead of
single words, so a shuffle carries few rows with dense payloads and every task's memory is bounded by a
block, never by a key.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import inspect
import os
import tempfile
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.session import ship

#: Text of one block of documents on average, and the most that a piece of a block holds in memory.
BLOCK_BYTES = 12 << 20
PIECE_BYTES = 12 << 20
#: Rows that one range of a prefix sum holds.
SPAN = 4096
#: Words of one document: maximal runs without ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; set to a temporary one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
        if not found:
            found = tempfile.mkdtemp(prefix="attesta-")
            spark.sparkContext.setCheckpointDir(found)
    return found


def persist(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder (a reliable checkpoint, so a lost executor loses nothing)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, text: str) -> int:
    """Measured UTF-8 bytes of a column: one aggregate over it, the same for any plan that gives these rows."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def grouped(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``df`` in no more partitions than blocks of ``like`` (default: itself), but two for each core at least.

    Many tiny partitions cost a task, and a file where a table is written, each. Nothing is shuffled; where the
    size is not known, or partitions are few, nothing changes.
    """
    size = _estimate(like if like is not None else df)
    if size >= 1 << 60:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES)))


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def block_count(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-text_bytes(df, text) // block_bytes))


def running_total(rows: DataFrame, key: str, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows of a smaller ``key``, a non-negative integer that is unique within ``by``.

    Summed within ranges of SPAN keys, then over one row per range, so no task holds more than a range or the ranges.
    """
    spans = rows.groupBy(*by, F.floor(F.col(key) / SPAN).alias("__span")).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "__span", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("__span", F.floor(F.col(key) / SPAN)).withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return held.join(spans, [*by, "__span"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__span", "__before", "__inside")


def encode(text: str | None) -> bytes:
    """UTF-8, also of lone surrogates."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Hashes(dict):
    """word -> 64-bit hash, remembered; emptied when it has ``most`` entries so memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each value of a string column, null as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def in_block(pieces: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """(ids, texts) of all pieces of one block, in (doc_id, text) order, so any order of arrival gives the same."""
    ids, texts = [], []
    for raw, ends, body in pieces:
        ids.append(np.frombuffer(raw, np.int64))
        data, at = zstandard.ZstdDecompressor().decompress(body), 0
        for end in np.frombuffer(ends, np.int64).tolist():
            texts.append(data[at:end])
            at = end
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = sorted(range(len(texts)), key=lambda i: (every[i], texts[i]))
    return every[order], [texts[i] for i in order]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of each value; grows with the value."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def sorted_delta(values: np.ndarray) -> bytes:
    """A sorted array as compressed planes of its differences' bytes."""
    delta = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes())


def from_delta(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


PIECE = "block long, ids binary, ends binary, body binary"


def _piece(block: int, ids: list[int], texts: list[bytes]) -> dict:
    return {
        "block": block,
        "ids": np.array(ids, np.int64).tobytes(),
        "ends": np.cumsum([len(x) for x in texts], dtype=np.int64).tobytes(),
        "body": zstandard.ZstdCompressor(level=1).compress(b"".join(texts)),
    }


def packer(bounds: list[int] | None, start: int = 0):
    """mapInArrow function over (doc_id, text): pieces of blocks.

    With ``bounds``, a document goes to the block of its doc_id's range (a null doc_id to block 0, as the
    smallest long). Without, blocks are cut in order of arrival and get ids unique to their content.
    """
    edges = None if bounds is None else np.array(bounds, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        size = 0

        def flush():
            rows = []
            for k, (ids, texts) in sorted(held.items()):
                row = _piece(k, ids, texts)
                if edges is None:
                    row["block"] = xxhash.xxh3_64_intdigest(row["ids"] + row["body"]) >> 1
                rows.append(row)
            held.clear()
            return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "ends", "body"))]))

        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            blocks = np.zeros(len(ids), np.int64) if edges is None else np.searchsorted(edges, ids, "right")
            for i, k, text in zip(ids.tolist(), blocks.tolist(), texts_of(batch.column(1)), strict=True):
                own = held.setdefault(k, ([], []))
                own[0].append(i)
                own[1].append(text)
                size += len(text) + 16
                if size >= (PIECE_BYTES if edges is not None else start or PIECE_BYTES):
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return pack


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most so many rows and bytes from now on, so that long texts don't fill a worker; also ships the package."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        own = spark.conf.get(key, None)
        if own is None or not 0 < _number(own) <= most:
            spark.conf.set(key, most)


def _number(setting: str) -> int:
    return int(setting) if setting.lstrip("-").isdigit() else 1 << 62


def trim() -> None:
    """Gives freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps between tasks, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, key: object, make):
    """``make()``, kept by this worker under ``name`` as long as ``key`` stays the same."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT.pop(name, None)
        _KEPT[name] = key, make()
    return _KEPT[name][1]


def lean(f, keeps: str | None = None):
    """``f``, an Arrow function of a group, two groups or batches, with memory trimmed when it has ended.

    Things that the worker keeps for tasks of other kinds are let go before; ``keeps`` names what ``f`` uses again.
    """
    if sum(p.default is p.empty for p in inspect.signature(f).parameters.values()) == 2:

        def run(left, right):
            _let_go(keeps)
            try:
                return f(left, right)
            finally:
                trim()
    else:

        def run(data):
            _let_go(keeps)
            out = f(data)
            if isinstance(out, pa.Table):
                trim()
                return out
            return _drained(out)

    return run


def _let_go(keeps: str | None) -> None:
    others = [k for k in _KEPT if k != keeps]
    for k in others:
        del _KEPT[k]
    if others:
        trim()


def _drained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from batches
    finally:
        trim()


def slices(texts: list, most: int = 4 << 20) -> Iterator[slice]:
    """Slices of a list of texts, each of about ``most`` bytes or characters (one longer text apart)."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield slice(start, len(texts))


def small_batches(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id long, text string) in Arrow batches of bounded size."""
    bounded(df.sparkSession)
    return grouped(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def range_bounds(ids: DataFrame, n: int) -> list[int]:
    """At most n - 1 distinct doc_ids that cut the table in about equal numbers of documents (n values reach the driver)."""
    if n < 2:
        return []
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(max(10_000, 20 * n)))).first()[0]
    return sorted(set(cuts or []))


def packed_ranges(df: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(pieces of blocks, number of blocks): block k holds doc_ids below those of block k + 1, equal ids together."""
    ids = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"))
    bounds = range_bounds(ids, block_count(df, text, block_bytes))
    return small_batches(df, doc_id, text).mapInArrow(lean(packer(bounds)), PIECE), len(bounds) + 1


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_mod(doc_id: int | None, mod: int) -> int:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a shared folder, local or remote."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

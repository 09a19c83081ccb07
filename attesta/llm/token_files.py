"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

``write_token_files`` packs documents into blocks of ascending doc_id, encodes each block once, counts all
ids, ranks them (rank 0 is the most frequent, ties by id) and writes one file per block. A rank takes 1 to 4
bytes; four 2-bit lengths fill a control byte, so a reader finds all lengths by one table lookup per control
byte. ``read_token_files`` decodes files with numpy alone.

File: b"ATK1", uint32 n_docs, uint64 n_ids (all little-endian), then int64 doc_ids, int64 ids per document,
the control bytes, the data bytes. ``ranks.u32`` beside the files holds the id of each rank.

Defined results: a null text is encoded as empty, so it holds the end id alone; equal doc_ids are ordered by
text; a null doc_id comes first and is stored as the smallest long; an empty table writes no block file; the string
of an added token (such as an end-of-text mark) in a text is that token, as the library has it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import BLOCK_BYTES, filesystem, in_block, lean, packed_ranges, persist, running_total, shared_dir, slices
from attesta.llm.units import encoder, tokenizer_json

MAGIC, HEAD, END_ID = b"ATK1", struct.Struct("<4sIQ"), 2
#: Text that is encoded at once; tasks that read files.
SLICE_BYTES, MOST_TASKS = 2 << 20, 100_000
#: Lengths that each control byte's four 2-bit fields stand for.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of an array of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    top = int(ranks.max(initial=0))
    extra = (ranks > 0xFF).view(np.uint8)
    for bound in (0xFFFF, 0xFFFFFF):
        if top > bound:
            extra = extra + (ranks > bound)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    fields = padded.reshape(-1, 4)
    control = fields[:, 0] | fields[:, 1] << 2 | fields[:, 2] << 4 | fields[:, 3] << 6
    most = 1 + (top > 0xFF) + (top > 0xFFFF) + (top > 0xFFFFFF)
    lanes = ranks.view(np.uint8).reshape(-1, 4)[:, :most]
    return control.tobytes(), lanes[np.arange(most) <= extra[:, None]].tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that pack_ids coded."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    return HEAD.pack(MAGIC, len(doc_ids), len(ranks)) + doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + b"".join(pack_ids(ranks))


def decode_file(raw: bytes, ids_of_ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of one file."""
    magic, docs, n = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    doc_ids, counts = (np.frombuffer(raw, "<i8", docs, at + 8 * docs * k) for k in (0, 1))
    at += 16 * docs
    control = -(-n // 4)
    return doc_ids, counts, ids_of_ranks[unpack_ids(raw[at : at + control], raw[at + control :], n)]


def _tokenise(spec: str, end_id: int):
    """Function of a block's pieces: one row of the block's ids, and how often each occurs."""

    def run(table: pa.Table) -> pa.Table:
        own = encoder(spec)
        doc_ids, texts = in_block(list(zip(*(table.column(c).to_pylist() for c in ("ids", "ends", "body")), strict=True)))
        end, size = np.array([end_id], own.dtype).tobytes(), own.dtype.itemsize
        code, body, lens, found = zstandard.ZstdCompressor(level=1).compressobj(), [], [], np.zeros(0, np.int64)
        for part in slices(texts, SLICE_BYTES):
            rows = [x + end for x in own.encode_many([x.decode("utf-8", "replace") for x in texts[part]])]
            texts[part] = [b""] * len(rows)
            raw = b"".join(rows)
            lens += [len(x) // size for x in rows]
            times = np.bincount(np.frombuffer(raw, own.dtype), minlength=len(found))
            times[: len(found)] += found
            found = times
            body.append(code.compress(raw))
        body.append(code.flush())
        used = np.flatnonzero(found)
        row = {
            "block": table.column("block")[0].as_py(),
            "ids": doc_ids.tobytes(),
            "lens": np.array(lens, np.int64).tobytes(),
            "body": b"".join(body),
            "wide": size == 4,
            "seen": zstandard.compress(np.concatenate([used, found[used]]).astype(np.int64).tobytes()),
        }
        return pa.Table.from_pylist([row], pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("body", pa.binary()), ("wide", pa.bool_()), ("seen", pa.binary())]))

    return run


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, times) over a task's blocks."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            used, times = np.frombuffer(zstandard.decompress(raw), np.int64).reshape(2, -1)
            if used.size and used[-1] >= len(total):
                total = np.concatenate([total, np.zeros(used[-1] + 1 - len(total), np.int64)])
            total[used] += times
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "times"])


def _write(out_dir: str, rank_of_id: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(out_dir)
        for batch in batches:
            for block, ids, lens, body, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(body), "<u4" if wide else "<u2")
                raw = encode_file(np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64), rank_of_id[tokens])
                name, part = f"{at}/block-{block:09d}.tok", f"{at}/.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(raw)
                fs.move(part, name)  # a task that runs twice leaves one whole file
                yield pa.RecordBatch.from_pylist([{"block": block, "path": f"block-{block:09d}.tok", "n_docs": len(lens) // 8, "n_ids": len(tokens)}])

    return run


def write_token_files(
    docs: DataFrame, out_dir: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Writes block files and ranks.u32 to ``out_dir`` (shared); returns (block, path, n_docs, n_ids), one row per file."""
    spec = tokenizer_json(tokenizer)
    packed, n = packed_ranges(docs, doc_id, text, block_bytes)
    spark = docs.sparkSession
    tokens = persist(
        packed.repartition(max(n, 1), "block").groupBy("block").applyInArrow(lean(_tokenise(spec, end_id), "encoder"), "block long, ids binary, lens binary, body binary, wide boolean, seen binary")
    )
    seen = tokens.select("seen").mapInArrow(lean(_seen), "id long, times long").groupBy("id").agg(F.sum("times").alias("times")).collect()  # a row per vocabulary entry
    ids_of_ranks = np.array([r["id"] for r in sorted(seen, key=lambda r: (-r["times"], r["id"]))], np.uint32)
    rank_of_id = np.zeros(int(ids_of_ranks.max(initial=0)) + 1, np.uint32)
    rank_of_id[ids_of_ranks] = np.arange(len(ids_of_ranks), dtype=np.uint32)
    fs, at = filesystem(out_dir)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/ranks.u32") as f:
        f.write(ids_of_ranks.astype("<u4").tobytes())
    index = tokens.select("block", "ids", "lens", "body", "wide").mapInArrow(lean(_write(out_dir, rank_of_id)), "block long, path string, n_docs long, n_ids long")
    return persist(index)


def read_token_files(spark: SparkSession, out_dir: str, index: DataFrame) -> DataFrame:
    """Decodes files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its little-endian uint32 ids."""
    files = running_total(index, "block", "n_ids", "start").select("path", "start")
    fs, at = filesystem(out_dir)
    with fs.open_input_stream(f"{at}/ranks.u32") as f:
        ids_of_ranks = np.frombuffer(f.read(), "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(out_dir)
        for batch in batches:
            for path, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_stream(f"{at}/{path}") as f:
                    doc_ids, counts, ids = decode_file(f.read(), ids_of_ranks)
                ends = np.cumsum(counts)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == -(2**63)), pa.array(begin + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    table = files.repartition(min(MOST_TASKS, max(1, index.count())))
    return table.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, out_dir: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` to files and reads them back: read_token_files' rows.

    The files stay in ``out_dir``; without one they go to the shared folder and are removed when they have been read.
    """
    spark = docs.sparkSession
    folder = out_dir or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = persist(read_token_files(spark, folder, write_token_files(docs, folder, **options)))
    if out_dir is None:
        fs, at = filesystem(folder)
        fs.delete_dir(at)
    return rows

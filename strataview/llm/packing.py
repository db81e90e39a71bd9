"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded.

A document's ids, with one end id, are cut into pieces of binary length: as many of
``max_len`` as fit, then the set bits of what remains, longest first. Every piece is a
sequence of its own whose length is a power of two, so a batch drawn from one length's
bucket has no padding. ``bucket`` is the length's exponent.

:func:`pack` makes the pieces; :func:`bucketed` writes them to the shared folder, one
folder a bucket, and reads them again, so a reader of one length opens that length's files
alone, and ``sequence_id`` stays what was written: unique, the task's number and a counter
in it, no shuffle. Each task writes its own files, so no bucket meets in one task. Long
texts are encoded in segments, and their pieces leave in batches of ``ROWS``.

A null or empty text has the end id alone. Rows are packed one by one, so repeated rows
and ids keep their own pieces; of the input only the id and the text are read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .byte_bpe import Encoder, encoder
from .shared import shared_folder, small_batches, texts

BATCH, ROWS = 2 << 20, 512


def decompose(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths of all documents end to end, and the number of pieces of each."""
    top = max_len.bit_length() - 1
    whole = lengths >> top
    bits = [(lengths >> k) & 1 for k in range(top - 1, -1, -1)]
    counts = whole + sum(bits)
    out = np.full(int(counts.sum()), max_len, np.int64)
    at = np.cumsum(counts) - counts + whole
    for k, bit in zip(range(top - 1, -1, -1), bits, strict=True):
        m = bit == 1
        out[at[m]] = 1 << k
        at += bit
    return out, counts


def pack(df: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, bucket, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers. ``max_len``
    must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    small_batches(df.sparkSession)
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def long(enc: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The pieces of one long text: its ids are held once, in the segments they came in."""
        held = [ids for _, _, ids in enc.parts(b.column(1))] + [np.array([end_id], np.uint32)]
        n = sum(map(len, held))
        size, _ = decompose(np.array([n]), max_len)
        start = np.cumsum(size) - size
        ready, done = np.zeros(0, np.uint32), 0
        for lo in range(0, len(size), ROWS):
            some = size[lo : lo + ROWS]
            want, parts = int(some.sum()), [ready]
            have = len(ready)
            while have < want:
                parts.append(held[done])
                have += len(held[done])
                held[done], done = None, done + 1
            ready = np.concatenate(parts)
            yield made(b.column(0), np.zeros(len(some), np.int64), start[lo : lo + ROWS], some, np.full(len(some), n), ready[:want])
            ready = ready[want:]

    def made(ids_of: pa.Array, owner: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum(size))) * 4
        blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
        return pa.RecordBatch.from_arrays([ids_of.take(pa.array(owner)), *map(pa.array, (start, size, total)), blob], ["doc_id", "start", "length", "doc_tokens", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in K.blocks(batches, "text", BATCH):
            if b.num_rows == 1 and b.column(1).nbytes > 2 * BATCH:
                yield from long(enc, b)
                continue
            n, ids = enc.encode(b.column(1))
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            size, counts = decompose(n, max_len)
            owner = np.repeat(np.arange(len(n)), counts)
            yield made(b.column(0), owner, np.cumsum(size) - size - (np.cumsum(n) - n)[owner], size, n[owner], ids)

    out = rows.mapInArrow(packed, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return out.select(
        "doc_id", "start", "length", F.log2("length").cast("int").alias("bucket"), "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per piece length; each task writes its own files, so no bucket meets in one task."""
    packed.write.partitionBy("bucket").parquet(path)


def bucketed(packed: DataFrame) -> DataFrame:
    """The pieces, written by bucket to the shared folder and read again; the same columns."""
    path = shared_folder(packed.sparkSession)
    write_buckets(packed, path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path).select(*packed.columns)

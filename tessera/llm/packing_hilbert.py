"""Packing along a space-filling curve.

Every document is encoded once, and its hashed vector, the mean of a fixed random
projection of its token ids, is quantised to a cell of a small grid.  The
cell's Hilbert index is the sort key: documents are dealt by range of (key,
``doc_id``), so neighbours on the curve, which resemble each other, stand together.
The ids of all documents in that order are one stream, cut into sequences of
``length``; what remains at its end is cut into sequences of falling powers of
two, which need no padding.  Long documents travel in rows of ``PART`` ids, so ranges that are even in rows are
about even in bytes, and no row is large.  The stream's positions come from prefix sums over the
partitions' totals, the only figures that the driver sees.

Defined results: a null or empty text is its end id alone; rows with equal
``doc_id`` are packed each, ordered by a hash of their ids; rows with a null ``doc_id`` come
first in their cell; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import forget, tidy, wide, written

#: Dimensions of the projection, bits of each, and the seed of the projection.
DIMS, DEPTH, SEED = 4, 8, 11
#: Ids of a row at most while documents are put in order.
PART = 4096
ENCODED = "doc_id long, key long, tie long, start long, n long, total long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Hilbert index of each row of a grid of 2**depth cells a side (Skilling's transposed form)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            on = (x[k] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[k] ^= t
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> b) & 1)
    return key


def curve_keys(lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as flat token ids."""
    table = np.random.default_rng(SEED).normal(size=(1 << 16, DIMS)).astype(np.float32)
    sums = np.zeros((len(lengths), DIMS))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        for k in range(DIMS):  # one dimension at a time bounds the memory
            sums[full, k] = np.add.reduceat(table[:, k][ids & 0xFFFF].astype(float), starts)
    spread = sums / np.sqrt(np.maximum(lengths, 1))[:, None]
    cells = np.clip((np.tanh(spread / 4) + 1) * (1 << (DEPTH - 1)), 0, (1 << DEPTH) - 1)
    return hilbert(cells, DEPTH)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "word") -> DataFrame:
    """``ENCODED``: a document's parts of up to PART ``ids``, with its ``key`` on the curve, a hash of its ids as ``tie`` and all of its ids as ``total``; the end id is included."""

    def run(batches):
        tidy()  # what an earlier stage left in this worker
        enc = encoder(tokenizer_path, kind)
        for b in batches:
            for at, lengths, ids in enc.encode(b.column(1)):
                keys = curve_keys(lengths, ids)
                ended = np.ascontiguousarray(np.insert(ids, np.cumsum(lengths), end_id).astype(enc.dtype))
                total = lengths + 1
                ends = np.cumsum(total)
                ties = np.array([xxhash.xxh64_intdigest(ended[e - n : e]) for e, n in zip(ends, total, strict=True)], np.uint64).view(np.int64)
                parts = -(-total // PART)
                own = np.repeat(np.arange(len(total)), parts)
                start = (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
                n = np.minimum(total[own] - start, PART)
                offsets = np.concatenate([[0], np.cumsum(n)]) * enc.dtype.itemsize
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ended)])
                columns = [b.column(0).take(pa.array(own + at)), *(pa.array(x) for x in (keys[own], ties[own], start, n, total[own])), blob.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ENCODED.split(", ")])
                del lengths, ids, keys, ended, ties, blob, columns  # before the next slice is encoded
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def _ends(total: int, length: int) -> list[int]:
    """Where the sequences of the stream's last, partial one end: its remainder as powers of two."""
    at = total - total % length
    out = []
    for b in range(length.bit_length() - 1, -1, -1):
        if (total - at) >> b & 1:
            at += 1 << b
            out.append(at)
    return out


def sequence_of(pos: int, length: int, tail: list[int], whole: int) -> tuple[int, int, int]:
    """Sequence id, its start and its end for a position of the stream."""
    k = pos // length
    if k < whole:
        return k, k * length, (k + 1) * length
    start = whole * length
    for j, end in enumerate(tail):
        if pos < end:
            return whole + j, start, end
        start = end
    raise ValueError("position behind the stream")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096, kind: str = "word") -> DataFrame:
    """One row per piece of a document, see ``PIECES``; every sequence is full but for the powers of two at the end."""
    spark = docs.sparkSession
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    enc = written(encoded(docs, tokenizer_path, end_id, kind), "encoded")
    order = ["key", "doc_id", "tie", "start"]
    dealt = enc.repartitionByRange(2 * wide(spark), *order).sortWithinPartitions(*order).select("doc_id", "start", "n", "total", "ids", F.spark_partition_id().alias("part"), "key", "tie")
    # the order is fixed by being written: totals and pieces come from the same files
    ordered = written(dealt, "ordered")
    forget(enc)
    totals = {r.part: r.n for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, bases = 0, {}
    for part in sorted(totals):
        bases[part] = base
        base += totals[part]
    tail, whole = _ends(base, length), base // length
    width = 2 if encoder(tokenizer_path, kind).dtype.itemsize == 2 else 4

    def run(batches):
        at: dict[int, int] = {}
        for b in batches:
            rows: list[list[int | None]] = [[] for _ in range(7)]
            for doc_id, first, n, total, ids, part in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                pos = at.get(part, bases[part])
                at[part] = pos + n
                wide_ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    seq, begin, end = sequence_of(pos + start, length, tail, whole)
                    size = min(n - start, end - pos - start)
                    row = (doc_id, first + start, size, zlib.crc32(wide_ids[start : start + size].tobytes()), total, seq, pos + start - begin)
                    for out, v in zip(rows, row, strict=True):
                        out.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=[f.split()[0] for f in PIECES.split(", ")])

    return _by_file(ordered, max(totals, default=0) + 1).mapInArrow(run, PIECES)


def _by_file(ordered: DataFrame, parts: int) -> DataFrame:
    """The written partitions again, each whole and in its order in a task of its own."""
    dealt = ordered.repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", "key", "doc_id", "tie", "start").select("doc_id", "start", "n", "total", "ids", "part")

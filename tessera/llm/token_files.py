"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``write_token_files`` deals the documents by range of ``doc_id``, encodes every
whole text and writes for each partition

* ``<part>.bin``: the ids of its documents one after another, little-endian
  unsigned 16-bit (32-bit if the vocabulary needs it);
* ``<part>.idx``: one little-endian unsigned 64-bit offset for each document and
  one more for the end, counted in ids from the start of the partition;
* ``<part>.ids``: the documents' ids, signed 64-bit;
* ``<part>.nul``: a byte for each document, 1 if its id is null.

The manifest it returns has one row for each partition, with the partition's
base: the number of ids in all partitions before it, from prefix sums over the
partitions' totals.  ``read_token_files`` maps the files into memory (or reads
them through pyarrow when they are not local) and gives one row per document.

Lost executors: a task names its files after its own attempt, and the manifest
carries the names that the successful attempts returned, so a task that runs
again never touches files that are already listed.

Defined results: a null text is an empty text and gives the end id alone; rows
with equal ``doc_id`` are all written, ordered by a hash of their text (equal
texts may stand in any order, they are the same); rows whose ``doc_id`` is null come
first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import scratch_path, wide

MANIFEST = "part int, path string, dtype string, docs long, ids long, first_null boolean"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    """A pyarrow file system for a folder of the shared file system, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches, folder: str, tokenizer_path: str, kind: str, end_id: int):
    """Encode one partition and write its files; yields one manifest row."""
    from pyspark import TaskContext

    enc = encoder(tokenizer_path, kind)
    part = TaskContext.get().partitionId()
    name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
    fsys, root = filesystem(folder)
    fsys.create_dir(root, recursive=True)
    docs = total = 0
    doc_ids: list[np.ndarray] = []
    nulls: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    out = None
    for batch in batches:
        keys = batch.column(0)
        nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
        doc_ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        for _, lengths, ids in enc.encode(batch.column(1)):
            out = out or fsys.open_output_stream(f"{root}/{name}.bin")
            ends = np.cumsum(lengths)
            out.write(np.insert(ids, ends, end_id).astype(enc.dtype).tobytes())
            sizes.append(lengths + 1)
            docs += len(lengths)
            total += int(lengths.sum()) + len(lengths)
    if out is None:
        return
    out.close()
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
    empty = np.concatenate(nulls)
    for suffix, data in (("idx", offsets), ("ids", np.concatenate(doc_ids)), ("nul", empty.astype("u1"))):
        with fsys.open_output_stream(f"{root}/{name}.{suffix}") as f:
            f.write(data.tobytes())
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int32()),
            "path": [f"{folder}/{name}"],
            "dtype": [enc.dtype.str],
            "docs": [docs],
            "ids": [total],
            "first_null": [bool(empty.any())],
        }
    )


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "byte", folder: str | None = None) -> DataFrame:
    """Write the documents (``doc_id``, ``text``) as token files; returns the manifest with ``base``.

    The manifest has one row for each partition written, which is all that the
    driver sees; its size follows the number of partitions, not of documents.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(2 * wide(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    rows = dealt.mapInArrow(lambda b: _write(b, folder, tokenizer_path, kind, end_id), MANIFEST).collect()
    base, listed = 0, []
    for r in sorted(rows, key=lambda r: r.part):
        listed.append((*r, base))
        base += r.ids
    return spark.createDataFrame(listed, MANIFEST + ", base long")


def _part(fsys, path: str, dtype: str, start: int, stop: int) -> np.ndarray:
    """Integers ``start`` to ``stop`` of a file, mapped into memory where it is local; elsewhere nothing but that range is read."""
    from pyarrow import fs

    if start >= stop:
        return np.zeros(0, dtype)
    if isinstance(fsys, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")[start:stop]
    size = np.dtype(dtype).itemsize
    with fsys.open_input_file(path) as f:
        return np.frombuffer(f.read_at((stop - start) * size, start * size), dtype)


def _read(batches):
    for batch in batches:
        for r in batch.to_pylist():
            fsys, path = filesystem(r["path"])
            for at in range(0, r["docs"], 4096):
                to = min(at + 4096, r["docs"])
                offsets = _part(fsys, f"{path}.idx", "<u8", at, to + 1).astype(np.int64)
                ids = _part(fsys, f"{path}.bin", r["dtype"], int(offsets[0]), int(offsets[-1]))
                near = offsets - offsets[0]
                crc = [zlib.crc32(ids[near[k] : near[k + 1]].astype("<u4").tobytes()) for k in range(to - at)]
                null = np.array(_part(fsys, f"{path}.nul", "u1", at, to)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(_part(fsys, f"{path}.ids", "<i8", at, to)), mask=null), pa.array(offsets[:-1] + r["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: its id, start, length and checksum of its ids."""
    spark: SparkSession = manifest.sparkSession
    parts = manifest.select("path", "dtype", "docs", "base").repartition(2 * wide(spark), "path")
    return parts.mapInArrow(_read, READ)


def token_ids(spark: SparkSession, path: str, start: int, stop: int, dtype: str) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one file, without reading the rest of it."""
    fsys, local = filesystem(path)
    return np.array(_part(fsys, f"{local}.bin", dtype, start, stop))

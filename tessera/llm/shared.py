"""Helpers that the operators of this subpackage share.

Work that must not be computed twice is cut off with a written table in the
folder that ``spark.checkpoint.dir`` names, which every executor and the driver
can reach.  Such a table outlives the executor that wrote it; nothing here uses
``localCheckpoint`` or a machine-local folder on a cluster.
"""

from __future__ import annotations

import ctypes
import threading
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import shared_dir

#: White space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Settings of a write to the shared folder: shuffle files go as it ends; bytes of a batch that a Python worker gets.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


_writing = threading.Lock()
_before: dict[int, tuple[int, dict[str, str]]] = {}  # session: writes that run, and its own settings


@contextmanager
def _write_settings(spark: SparkSession):
    """``WRITING`` holds while any write of the session runs; the first one sets it, the last one puts back what was before."""
    with _writing:
        n, before = _before.get(id(spark), (0, {}))
        if not n:
            before = {k: spark.conf.get(k) for k in WRITING}
            for k, v in WRITING.items():
                spark.conf.set(k, v)
        _before[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _writing:
            n, before = _before.pop(id(spark))
            if n > 1:
                _before[id(spark)] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends.

    Its shuffle files have no reader after that, and go as the write ends.  The table itself stays for
    whoever reads the result: ``forget`` drops it when that is over, ``sweep`` drops those of former sessions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _write_settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, older_than_s: float = 24 * 3600) -> int:
    """Delete scratch tables that are older than given, of whatever session; returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera")
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return 0
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() < (time.time() - older_than_s) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


def told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The driver's rows as a table that the plan holds.

    ``createDataFrame`` of a list would have Python workers unpickle it, in a daemon of their own beside the
    operators' one, and executors hold those for a minute longer.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    mine = f"{shared_dir(spark)}/tessera/".split(":", 1)[-1].lstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(mine):  # nothing but scratch is ever deleted
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` doesn't have, nor any with a letter added; names that differ in case only clash too."""
    taken = {c.lower() for c in df.columns}
    found = (x for k in range(26 * (len(taken) + n) + n) if not any(c.startswith(x := f"_t{k}_") for c in taken))
    return [next(found) for _ in range(n)]


def tidy() -> None:
    """Give memory that a Python worker has freed back to the system: workers are reused by stages that need less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def wide(spark: SparkSession) -> int:
    """Number of partitions to deal rows to: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph, by large-star and small-star rounds.

    ``edges`` has two columns ``a`` and ``b`` (long, not null).  Returns
    ``(node, root)`` for every node of an edge, ``root`` being the smallest
    node that it can reach.  Every round is a pair of group-and-join steps whose
    result is written to the shared folder, so the lineage stays short; the number
    of rounds grows with the logarithm of a component's diameter.  Self loops
    and repeated edges are harmless; an empty table gives an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = written(e.where("a <> b").distinct(), name)
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = written(small.unionAll(down.select("a", F.col("m").alias("b"))).distinct(), name)
        # all edges form stars when no node is both a root and a child, and each child has one root
        n, n_child = nxt.agg(F.count("*"), F.count_distinct("a")).first()
        inner = nxt.select(F.col("b").alias("a")).join(nxt.select("a"), "a", "left_semi").limit(1).count()
        forget(e)
        e = nxt
        if n == n_child and inner == 0:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

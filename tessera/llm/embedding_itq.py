"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A bounded sample of the vectors gives the mean, the principal axes and rotations that
iterative quantisation learns, so that the signs of a vector's rotated
coordinates are balanced bits.  The bits of all rotations in a row are cut into keys of
equal width, and one table for each key brings together the vectors that agree there.
Pairs in a bucket are reranked with the original vectors: a
cosine of ``threshold`` or more in double precision is a link.  The index may miss
pairs (they differ in all keys); it never adds one.

Keys are wider for more vectors, so that buckets stay small, and then there are more of
them: tables are added, or keys narrowed, until of made-up pairs whose cosine is just ``threshold``
a share of ``MEET`` meets.  The chance to be found thus doesn't fall with the size of a table.

Equal vectors are one class before anything is compared.  A bucket yields counts and
a spanning forest, never its pairs; a pair that meets in several tables counts in the
first of them.  A bucket with more than ``BLOCK`` classes is split into blocks, and
each two blocks meet in a task of their own, so no task holds a whole hot bucket.

Each length of vectors has an index of its own.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component
link with nothing; vectors of different lengths never link; rows with a null
``vec_id`` link with nothing and have a null ``component_id``; rows with
equal ``vec_id`` are one node of the graph and each keeps a row; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, wide, written
from .simhash_pivots import forest

#: Vectors that the rotation is learned from at most, and rounds of learning.
SAMPLE, ROUNDS = 4096, 40
#: Bits of a rotation at most, bits of a key at least (unless too few pairs meet) and at most, tables at most.
BITS, NARROW, WIDE, TABLES = 64, 8, 30, 256
#: Share of the pairs at the threshold that has to meet in a table, and made-up pairs that measure it.
MEET, PAIRS = 0.95, 2048
#: Classes of a bucket that a task compares at once.
BLOCK = 2048


@dataclass(frozen=True)
class Index:
    """Mean, projection (dimensions x bits), bits of a key and number of tables."""

    mean: np.ndarray
    projection: np.ndarray
    width: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Keys of unit vectors, a column for each table."""
        on = (x - self.mean) @ self.projection[:, : self.width * self.tables] >= 0
        return on.reshape(len(x), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int32))


def key_width(n: int) -> int:
    """Bits of a key for ``n`` vectors, so that buckets hold about a thousand at most."""
    return min(WIDE, max(NARROW, ceil(log2(max(n, 2))) - 10))


def threshold_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is ``threshold``: towards other vectors of the sample, and in any direction."""
    rng = np.random.default_rng(13)
    x = sample[np.arange(PAIRS) % len(sample)]
    out = []
    for to in (sample[rng.integers(0, len(sample), PAIRS)], rng.normal(size=x.shape)):
        to = to - (to * x).sum(1, keepdims=True) * x
        long = np.linalg.norm(to, axis=1)
        on = long > 1e-6
        y = threshold * x[on] + np.sqrt(max(0.0, 1 - threshold**2)) * to[on] / long[on, None]
        if len(y):
            out.append((x[on], y))
    return out


def learn(sample: np.ndarray, n: int, threshold: float) -> Index:
    """The index for ``n`` unit vectors: principal axes times learned rotations, as many as needed for ``MEET``."""
    mean = sample.mean(0)
    bits = min(BITS, sample.shape[1])
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=True)
    axes = axes[:bits].T
    v = (sample - mean) @ axes
    rng = np.random.default_rng(7)
    parts: list[np.ndarray] = []
    pairs = threshold_pairs(sample, threshold)
    agree = [np.zeros((len(x), 0), bool) for x, _ in pairs]
    for width in range(key_width(n), 0, -1):
        apart = [np.ones(len(x), bool) for x, _ in pairs]
        for table in range(TABLES):
            while len(parts) * bits < width * (table + 1):
                rotation, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
                for _ in range(ROUNDS):
                    b = np.where(v @ rotation >= 0, 1.0, -1.0)
                    left, _, right = np.linalg.svd(b.T @ v)
                    rotation = (left @ right).T
                parts.append(axes @ rotation)
                same = [((x - mean) @ parts[-1] >= 0) == ((y - mean) @ parts[-1] >= 0) for x, y in pairs]
                agree = [np.concatenate(z, axis=1) for z in zip(agree, same, strict=True)]
            apart = [a & ~g[:, width * table : width * (table + 1)].all(1) for a, g in zip(apart, agree, strict=True)]
            if all(a.mean() <= 1 - MEET for a in apart):
                return Index(mean, np.concatenate(parts, axis=1), width, table + 1)
    # so few meet by any key that all are compared with all
    return Index(mean, np.zeros((len(mean), 0)), 0, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), dim)


def _bucket(table: int, threshold: float, a, b):
    """Counts and links of a bucket: each row of ``a`` with the rows of ``b`` (None: with later rows of ``a``)."""
    rep, keys, weight, x = a
    rep2, keys2, weight2, x2 = a if b is None else b
    n = np.zeros(len(rep))
    n2 = n if b is None else np.zeros(len(rep2))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(rep), 512):
        end = min(at + 512, len(rep))
        near = x[at:end] @ x2.T >= threshold
        if b is None:
            near &= np.arange(len(rep2))[None, :] > np.arange(at, end)[:, None]
        i, j = np.nonzero(near)
        i += at
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= keys[i, t] != keys2[j, t]
        i, j = i[first], j[first]
        if len(i):
            n += np.bincount(i, weight2[j], minlength=len(n))
            n2 += np.bincount(j, weight[i], minlength=len(n2))
            links.append(forest(rep[i], rep2[j]))
    counts = [(rep, n)] if b is None else [(rep, n), (rep2, n2)]
    if b is None and len(links) > 1:
        links = [forest(*(np.concatenate(z) for z in zip(*links, strict=True)))]
    return counts, links


def _compare(threshold: float, dim: int, tables: int):
    names = ["a", "b", "n"]

    def out(table, groups):
        sides = [g for g in (0, 1) if g in groups]
        a = groups[sides[0]]
        counts, links = _bucket(table, threshold, a, groups[1] if len(sides) == 2 else None)
        for rep, n in counts:
            on = n > 0
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[on]), pa.array(n[on].astype(np.int64))], names=names)
        for a_, b_ in links:
            if len(a_):
                yield pa.RecordBatch.from_arrays([pa.array(a_), pa.array(b_), pa.array(np.zeros(len(a_), np.int64))], names=names)

    def run(batches):
        held, last = [], None

        def flush():
            table, _, one = last
            merged = [np.concatenate(z) for z in zip(*held, strict=True)]
            side, rest = merged[0], merged[1:]
            groups = {int(s): tuple(r[side == s] for r in rest) for s in np.unique(side)}
            if len(groups) == 2 or one:
                yield from out(table, groups)

        for batch in batches:
            if not batch.num_rows:
                continue
            table, key, pair, side, rep, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            keys = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(rep), tables)
            x = _matrix(batch.column(7), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            change = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            for s, e in zip([0, *change], [*change, len(rep)], strict=True):
                now = (int(table[s]), (int(key[s]), int(pair[s])), int(pair[s]) >> 32 == int(pair[s]) & 0xFFFFFFFF)
                if last is not None and now != last:
                    yield from flush()
                    held = []
                last = now
                held.append((side[s:e], rep[s:e], keys[s:e], weight[s:e], x[s:e]))
        if held:
            yield from flush()

    return run


def _searched(rows: DataFrame, dim: int, n: int, threshold: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """Classes of the ``n`` vectors of a length (named by ``h1``), and their counts and links."""
    spark = rows.sparkSession
    classes = rows.where(F.size("e") == dim).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("e").alias("e"))
    picked = classes.orderBy(F.xxhash64("rep", "h1"), "rep").limit(sample).select("e").collect()
    x = np.array([r.e for r in picked], float).reshape(len(picked), dim)
    index = learn(x / np.linalg.norm(x, axis=1, keepdims=True), n, threshold)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        for b in batches:
            v = _matrix(b.column(4), dim)
            keys = shared.value.keys(v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int32)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=[*b.schema.names, "keys"])

    classes = written(classes.mapInArrow(encode, "h1 long, h2 int, rep long, w long, e array<double>, keys array<int>"), "codes")
    keyed = classes.select("h1", "h2", F.posexplode("keys").alias("table", "key"))
    full = keyed.groupBy("table", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("long"))
    mine = F.pmod(F.xxhash64("h1", "h2"), "blocks")
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # block pairs (low, high) that a row's block takes part in; side 0 is the low one
    pairs = F.transform(other, lambda o: F.struct((F.least(o, "mine") * (1 << 32) + F.greatest(o, "mine")).alias("pair"), F.when(o >= F.col("mine"), 0).otherwise(1).alias("side")))
    met = keyed.join(full, ["table", "key"]).withColumn("mine", mine).select("table", "key", "h1", "h2", F.explode(pairs).alias("p"))
    met = met.select("table", "key", "p.pair", "p.side", "h1", "h2").join(classes.select("h1", "h2", "w", "keys", "e"), ["h1", "h2"])
    met = met.select("table", "key", "pair", "side", "h1", "w", "keys", "e").repartition(2 * wide(spark), "table", "key", "pair").sortWithinPartitions("table", "key", "pair", "side")
    return classes.select("h1", "h2", "rep", "w"), written(met.mapInArrow(_compare(threshold, dim, index.tables), "a long, b long, n long"), "links")


def linked(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``vectors`` (``vec_id``, ``embedding``): ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    e = F.col("embedding").cast("array<double>")
    size = F.aggregate("e", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("e") > 0) & fine & (size > 0), F.lit(False))
    # scaling by the largest component keeps norms of huge and tiny vectors finite
    scaled = F.transform("e", lambda v: v / F.col("top"))
    rows = rows.withColumn("good", good).withColumn("top", size)
    rows = rows.select("vec_id", F.when(F.col("good"), scaled).alias("e"))
    rows = rows.withColumns({"h1": F.xxhash64("e"), "h2": F.hash("e")})
    # all that is needed of rows but their vectors; read by every step that needs no vector
    ids = written(rows.select("vec_id", "h1", "h2", F.size("e").alias("d")), "ids")
    dims = ids.where("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").collect()
    if not dims:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    each = [_searched(rows, r.d, r["count"], threshold, sample) for r in dims]
    classes, found = (reduce(DataFrame.unionAll, z) for z in zip(*each, strict=True))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "ca")
    # rows that share an id are one node of the graph, whatever their vectors
    of_id = ids.where("d > 0").groupBy("vec_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("vec_id", "low")
    alike = ids.where("d > 0").join(of_id, "vec_id").select(F.col("h1").alias("a"), F.col("low").alias("b"))
    roots = components(found.where("n = 0").select("a", "b").unionAll(alike))
    named = classes.join(counts, F.col("h1") == F.col("ca"), "left").join(roots, F.col("h1") == F.col("node"), "left")
    named = named.select("h1", "h2", "rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root", "h1").alias("group"))
    lowest = named.groupBy("group").agg(F.min("rep").alias("c"))
    at = ids.join(named.join(lowest, "group").select("h1", "h2", "n", "c"), ["h1", "h2"], "left")
    on = F.col("d") > 0
    component = F.when(on, F.col("c")).otherwise(F.col("vec_id"))
    return at.select("vec_id", F.when(on, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

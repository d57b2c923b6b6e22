"""First shingles of texts in an order by exact counts: what an exact join by Jaccard has to compare.

Put the shingles of all texts in one order.  Two sets whose Jaccard is ``threshold`` or more
share a shingle among the first n - ceil(threshold * n) + 1 of each (n: the set's size).  The rarer
the shingles that come first, the fewer texts meet there for nothing; a shingle that no other
text has brings nobody together and needs no row.  So the order is by the number of texts that
have a shingle, which ``first_keys`` counts over all texts:

1. Every shingle goes as a short code (top bits of its hash, enough that few codes are shared by chance) to the
   task of its range of codes, in blocks that name the batch of texts they came from.
2. That task counts the codes and sends back to each batch those that more than one text has.
3. Each batch then knows for each of its texts which shingles it shares, and how many it has to itself,
   and gives one row for each shared shingle among the first.

Blocks are sorted and compressed, so both exchanges together stay near the size of the compressed texts.  The
shingles that a great share of all texts have (``hot_shingles``, a table with a size bound) would all
meet in one task; they come last in the order by rule and aren't sent at all.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import wide
from .shingles import block, columns_of, shingle_set

#: Shingles, and texts, of a batch; a text with more shingles is a batch of its own.
BATCH, TEXTS = 1 << 19, 1 << 16
#: Shingles that a counting task holds at once, about.
RANGE = 1 << 20
#: Share of all texts that makes a shingle hot, and hot shingles at most: the share rises until the bound holds.
HOT, HOT_MOST = 0.01, 1 << 18

_CODES, _TEXTS, _SHARED = 0, 1, 2
_ROW = "place long, kind int, batch long, block binary"


def hot_share(texts: int, shingles: int) -> float:
    """Share of the texts from which on a shingle is hot; at most HOT_MOST shingles reach half of it."""
    return max(HOT, 2 * shingles / max(texts, 1) / HOT_MOST)


def hot_shingles(counted: DataFrame, texts: int, shingles: int) -> np.ndarray:
    """Hot shingles, rare ones first; ``counted`` has ``hash`` and ``count`` of those frequent in some batch.

    Each text counts a shingle once, so no more than shingles / (share * texts / 2) can reach the bound.
    """
    least = hot_share(texts, shingles) * texts / 2
    found = counted.groupBy("hash").agg(F.sum("count").alias("n")).where(F.col("n") >= least).collect()
    return np.array([r.hash for r in sorted(found, key=lambda r: (r.n, r.hash))], np.int64).view(np.uint64)


def prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many shingles in order a set of size ``n`` has to show."""
    return np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)


def _row(place, kind, batch, blocks):
    k = len(blocks)
    at = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), k))
    return pa.RecordBatch.from_arrays([at(place), pa.array(np.full(k, kind, np.int32)), at(batch), pa.array(blocks, pa.binary())], names=["place", "kind", "batch", "block"])


def _split(size: int, threshold: float, shift: int, ranges: int, hot):
    """A function for mapInArrow over (node, text): blocks of codes by range, and for each batch what its texts are."""

    def send(held, batch):
        node, sets, cold, shown = (list(x) for x in zip(*held, strict=True))
        n, m = (np.array([len(s) for s in x], np.int64) for x in (sets, cold))
        codes = np.concatenate(cold) >> np.uint64(shift)
        own = np.repeat(np.arange(len(held)), m)
        order = np.argsort(codes)
        codes, own = codes[order], own[order]
        # ranges split the codes evenly; the top 32 bits of a hash are enough to tell
        place = ((codes << np.uint64(shift) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = [*cuts[1:], len(place)]
        yield _row(place[cuts], _CODES, batch, [block(np.diff(codes[a:b], prepend=np.uint64(0)), own[a:b]) for a, b in zip(cuts, ends, strict=True)])
        at = np.repeat(np.arange(len(held)), [len(s) for s in shown])
        texts = block(np.array(node, np.int64).view(np.uint64), n, m, at, np.concatenate(shown))
        yield _row(batch // TEXTS % ranges, _TEXTS, batch, [texts])

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        ranked = hot.value
        by_hash = np.argsort(ranked)
        held, rows = [], 0
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = shingle_set(text.as_py(), size)
                at = np.searchsorted(ranked, own, sorter=by_hash) if len(ranked) else np.zeros(len(own), np.int64)
                rank = by_hash[np.minimum(at, len(ranked) - 1)] if len(ranked) else at
                is_hot = ranked[rank] == own if len(ranked) else np.zeros(len(own), bool)
                cold = own[~is_hot]
                # hot ones show only where the others are too few
                room = max(0, int(prefix(np.array([len(own)]), threshold)[0]) - len(cold))
                held.append((node, own, cold, ranked[np.sort(rank[is_hot])[:room]]))
                rows += len(own)
                if rows >= BATCH or len(held) >= TEXTS:
                    yield from send(held, base)
                    base, held, rows = base + TEXTS, [], 0
        if held:
            yield from send(held, base)

    return run


def _groups(batches, column: int):
    """Rows of a sorted column's equal values, as lists."""
    held, last = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[column] != last:
                yield last, held
                held = []
            last = row[column]
            held.append(row)
    if held:
        yield last, held


def _shared(batches):
    """Of the codes of a range those that occur more than once, with their counts, back to their batches."""
    for _, rows in _groups(batches, 0):
        for row in rows:
            if row[1] == _TEXTS:
                yield _row([0], _TEXTS, row[2], [row[3]])
        parts = [(row[2], *columns_of(row[3])) for row in rows if row[1] == _CODES]
        if not parts:
            continue
        codes = np.concatenate([np.cumsum(c, dtype=np.uint64) for _, c, _ in parts])
        own = np.concatenate([o for _, _, o in parts])
        order = np.argsort(codes, kind="stable")
        run = np.cumsum(np.diff(codes[order], prepend=codes[order[0]] + np.uint64(1)) != 0) - 1
        count = np.empty(len(codes), np.int64)
        count[order] = np.bincount(run)[run]
        many = count > 1
        ends = np.cumsum([len(o) for _, _, o in parts])
        for (batch, _, _), a, b in zip(parts, [0, *ends], ends, strict=False):
            on = many[a:b]
            if on.any():
                yield _row([0], _SHARED, batch, [block(own[a:b][on], codes[a:b][on], count[a:b][on])])


def _firsts(threshold: float):
    """Rows (key, node, size, place) of the shared shingles among the first of each text, by batch."""

    def run(batches):
        for _, rows in _groups(batches, 2):
            node, n, m, at, shown = next(columns_of(row[3]) for row in rows if row[1] == _TEXTS)
            n, m, at = n.astype(np.int64), m.astype(np.int64), at.astype(np.int64)
            parts = [columns_of(row[3]) for row in rows if row[1] == _SHARED]
            own, codes, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64),) * 3
            order = np.lexsort((codes, count, own))
            own, codes = own[order].astype(np.int64), codes[order]
            shared = np.bincount(own, minlength=len(n))
            before = np.cumsum(shared) - shared
            rank = np.arange(len(own)) - before[own]
            place = (m - shared)[own] + rank
            on = place < prefix(n, threshold)[own]
            last = m[at] + np.arange(len(at)) - (np.cumsum(np.bincount(at, minlength=len(n))) - np.bincount(at, minlength=len(n)))[at]
            who = np.concatenate([own[on], at])
            if len(who):
                key = np.concatenate([codes[on], shown]).view(np.int64)
                out = [key, node[who].view(np.int64), n[who], np.concatenate([place[on], last])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "node", "size", "place"])

    return run


def first_keys(texts: DataFrame, size: int, threshold: float, shingles: int, hot: np.ndarray) -> DataFrame:
    """Rows ``key, node, size, place``: the shared shingles among the first of every text's set of ``size``.

    ``texts`` has ``node`` (long) and ``text`` (as ``pressed`` gives it), with ``shingles`` in all.  Texts without words,
    and texts with more shingles to themselves than they have to show, have no row.
    """
    spark = texts.sparkSession
    parts = 2 * wide(spark)
    ranges = parts * ceil(shingles / (RANGE * parts) or 1)
    shift = 64 - min(64, max(32, ceil(log2(shingles + 2)) + 8))
    told = spark.sparkContext.broadcast(hot)
    split = texts.select("node", "text").mapInArrow(_split(size, threshold, shift, ranges, told), _ROW)
    split = split.repartitionById(parts, F.pmod("place", F.lit(parts)).cast("int")).sortWithinPartitions("place")
    back = split.mapInArrow(_shared, _ROW)
    back = back.repartitionById(parts, F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int")).sortWithinPartitions("batch")
    return back.mapInArrow(_firsts(threshold), "key long, node long, size long, place long")

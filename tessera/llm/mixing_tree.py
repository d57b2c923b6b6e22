"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt to blocks by a hash, which permutes
them; the blocks of a source are drawn in a hashed order.  A source's target in words
says how many draws it gets: whole passes over all its blocks, then single blocks up to the
one in which the target falls.  The blocks about it, with ``MARGIN`` documents or more on either
side if there are so many, are drawn in part: in a hashed order, each document that still fits is taken.
Should they hold more than ``EDGE`` documents, they are split again by another hash until the rest is that small.
The vector of draws by source is split among the output shards by a binary tree: each node
hands its left half of the shards a multivariate-hypergeometric part of its draws and
the rest to the right, so each shard's make-up is that of draws without replacement.
A leaf's draws are consecutive in the source's order, hence disjoint from all others';
inside a shard rows are shuffled by a hash.  ``takes`` says of each document which shards take it.

Numbers of blocks and shards follow from the counts: blocks of ``BLOCK_DOCS`` documents, at least ``BLOCKS`` if they have
``LEAST_DOCS`` and ``MOST_BLOCKS`` at most; shards of ``SHARD_WORDS`` words, at least ``SHARDS`` unless there are fewer draws.
The driver sees one row for each source and block (MOST_BLOCKS times the number of
sources at most), never a document.

Defined results: a null text has size 0; sources stand by code point, null last, and
null is a source; documents of size 0 are taken with 0 words; equal rows are
documents of their own; an empty table, or one without words, takes nothing; further columns, whatever their names,
are ignored by ``takes`` and kept by ``mixed``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, free_names, told, wide, written

#: Blocks of a source: at least (if they have so many documents), by documents of a block, and at most.
BLOCKS, LEAST_DOCS, BLOCK_DOCS, MOST_BLOCKS = 512, 16, 4096, 8192
#: Output shards at least, words of a shard, and the seed of all draws.
SHARDS, SHARD_WORDS, SEED = 64, 2_000_000, 5
#: Documents of the partly drawn blocks on either side of a source's target, if it has so many, and those that a task looks at.
MARGIN, EDGE = 1000, 1 << 14
#: Documents among which the choice is exact, and words up to which sums are looked at for that.
EXACT, EXACT_WORDS = 48, 1 << 22
#: Share of all words that the mix has, weights by source in turn, and most passes over a source.
SHARE, WEIGHTS, PASSES = 1.5, (3, 1, 2), 2.0
#: Rows of the plan up to which it is broadcast.
BROADCAST_ROWS = 100_000


def targets(sizes: list[float], share: float = SHARE, weights=WEIGHTS, passes: float = PASSES) -> list[float]:
    """Words of each source in the mix: by weight, stopped at ``passes`` times its size, the excess reshared."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    left = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = [k for k, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        unit = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if weight[k] * unit > passes * sizes[k]]
        if not full:
            for k in open_:
                out[k] = weight[k] * unit
            break
        for k in full:
            out[k] = passes * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source (columns) in each shard (rows); every column sums to its quota."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(own: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = own
            return
        mid = (first + last) // 2
        part = int(own.sum()) * (mid - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(own, part, method="marginals") if own.sum() else own
        node(left, first, mid)
        node(own - left, mid, last)

    node(np.asarray(quotas, np.int64), 0, shards)
    return out


def blocks_for(documents: int) -> int:
    """Blocks of a source of so many documents."""
    return min(MOST_BLOCKS, max(1, min(BLOCKS, documents // LEAST_DOCS), ceil(documents / BLOCK_DOCS)))


def shards_for(words: float, draws: int) -> int:
    """Shards of a mix of so many words."""
    return max(1, min(draws, max(SHARDS, ceil(words / SHARD_WORDS))))


@dataclass
class Plan:
    """``sources``: (source, size, target); ``draws``: (source, block, pass, shard, partly); ``fills``: words that a source's partly drawn blocks have to give."""

    sources: list[tuple[str | None, int, float]]
    draws: list[tuple[str | None, int, int, int, bool]]
    fills: list[tuple[str | None, int]]
    shards: int


def _permuted(blocks: list[tuple[int, int, int]], name: str | None, seed: int) -> list[tuple[int, int, int]]:
    return sorted(blocks, key=lambda b: (zlib.crc32(f"{seed} {name!r} {b[0]}".encode()), b[0]))


def _edge(order: list[tuple[int, int, int]], rest: int) -> tuple[int, int, int]:
    """Of blocks (block, words, documents) in order: those before the first number are drawn, those up to the second in part, to give the third in words."""
    at = 0
    while at < len(order) and order[at][1] <= rest:
        rest -= order[at][1]
        at += 1
    # around the block in which the target falls: blocks before it are given back, blocks behind it added
    end, before, behind = at, 0, 0
    while rest and at and before < MARGIN:
        at -= 1
        rest += order[at][1]
        before += order[at][2]
    while rest and end < len(order) and behind < MARGIN:
        behind += order[end][2]
        end += 1
    return at, end, rest


def plan(blocks: list[tuple[str | None, int, int, int]], shards: int | None = None, seed: int = SEED, share: float = SHARE, weights=WEIGHTS, passes: float = PASSES) -> Plan:
    """The draws for blocks given as (source, block, words, documents)."""
    by: dict[str | None, list[tuple[int, int, int]]] = {}
    for source, block, words, documents in blocks:
        by.setdefault(source, []).append((block, words, documents))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for _, w, _ in by[s]) for s in names]
    wanted = targets(sizes, share, weights, passes)
    lists: list[list[tuple[int, int, bool]]] = []
    fills = []
    for name, size, target in zip(names, sizes, wanted, strict=True):
        order = _permuted(by[name], name, seed)
        whole = int(target // size) if size else 0
        at, end, rest = _edge(order, round(target - whole * size))
        lists.append([(b, p, False) for p in range(whole) for b, _, _ in order] + [(b, whole, k >= at) for k, (b, _, _) in enumerate(order[:end])])
        if end > at:
            fills.append((name, rest))
    shards = shards or shards_for(sum(wanted), sum(map(len, lists)))
    parts = split(np.array([len(x) for x in lists]), shards, seed)
    out = []
    for k, (name, draws) in enumerate(zip(names, lists, strict=True)):
        shard_of = np.repeat(np.arange(shards), parts[:, k])
        out += [(name, b, p, int(s), part) for (b, p, part), s in zip(draws, shard_of, strict=True)]
    return Plan(list(zip(names, sizes, wanted, strict=True)), out, fills, shards)


def size_of(text: str = "text") -> Column:
    """Number of words: runs of anything but white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a source's last documents (``copies`` equal ones in a row): each that still fits is taken once more.

    Of the first ``EXACT`` of them it is chosen anew which are taken, so that the fewest words are missing.
    """
    rows = rows.sort_values(["tie", "doc_id", "same", "size"], kind="stable", na_position="last")
    sizes, copies = ([int(x) for x in rows[c]] for c in ("size", "copies"))
    left, extra = int(rows["fill"].iloc[0]), []
    for size, n in zip(sizes, copies, strict=True):
        extra.append(min(n, left // size) if size else 0)
        left -= extra[-1] * size
    # of the first few documents, the choice that leaves the fewest words: sums as bits of an integer
    few = [k for k in range(min(EXACT, len(sizes))) for _ in range(min(EXACT, copies[k]))][:EXACT]
    free = {k: min(extra[k], few.count(k)) for k in set(few)}
    room = left + sum(n * sizes[k] for k, n in free.items())
    if room <= EXACT_WORDS:
        reach = [1]
        for k in few:
            reach.append(reach[-1] | reach[-1] << sizes[k] & (1 << room + 1) - 1)
        for k, n in free.items():
            extra[k] -= n
        best = reach[-1].bit_length() - 1
        for at in range(len(few) - 1, -1, -1):
            if sizes[few[at]] and not reach[at] >> best & 1:
                extra[few[at]] += 1
                best -= sizes[few[at]]
    return rows.assign(extra=extra)[["doc_id", "source", "block", "size", "same", "copies", "extra"]]


def _last(sized: DataFrame, made: Plan) -> DataFrame:
    """Documents of the partly drawn blocks, equal ones as one row with ``copies``, and how many of them are taken once more: ``extra``."""
    spark = sized.sparkSession
    partly = [(s, b) for s, b, _, _, part in made.draws if part]
    there = told(spark, partly, "bs string, bb int")
    hit = sized.join(_maybe_broadcast(there, len(partly)), F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")), "left_semi")
    names = ["doc_id", "source", "block", "size", "same"]
    edge = written(hit.groupBy(*names).agg(F.count("*").alias("copies")), "edge")
    fills, done, level = dict(made.fills), [], 0
    while True:
        level += 1
        n = {r.source: r.n for r in edge.groupBy("source").agg(F.count("*").alias("n")).collect()}
        large = {s: max(16, min(MOST_BLOCKS, ceil(2 * k / EDGE) * 16)) for s, k in n.items() if k > EDGE}
        if not large:
            break
        parts = told(spark, list(large.items()), "ps string, parts int")
        cut = edge.join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("ps")), "left").drop("ps")
        cut = written(cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "same", "size", F.lit(SEED + level)), "parts").cast("int")).drop("parts"), "cut")
        found: dict[str | None, list[tuple[int, int, int]]] = {}
        for r in cut.where("part is not null").groupBy("source", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("w"), F.sum("copies").alias("n")).collect():
            found.setdefault(r.source, []).append((r.part, int(r.w), r.n))
        said = []
        for source, some in found.items():
            order = _permuted(some, source, SEED + level)
            at, end, fills[source] = _edge(order, fills[source])
            said += [(source, b, 0 if k < at else 1) for k, (b, _, _) in enumerate(order[:end])]
        chosen = told(spark, said, "ps string, pp int, undecided int")
        cut = cut.join(_maybe_broadcast(chosen, len(said)), F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")), "left")
        open_ = F.col("part").isNull() | (F.coalesce("undecided", F.lit(0)) == 1)
        done.append(cut.where(~open_).select(*names, "copies", F.when(F.col("undecided") == 0, F.col("copies")).otherwise(0).alias("extra")))
        edge = written(cut.where(open_).select(*names, "copies"), "edge")
    words = told(spark, list(fills.items()), "fs string, fill long")
    last = edge.join(_maybe_broadcast(words, len(fills)), F.col("source").eqNullSafe(F.col("fs"))).drop("fs")
    last = last.withColumn("tie", F.xxhash64("doc_id", F.lit(SEED + 1)))
    filled = last.groupBy("source").applyInPandas(_fill, "doc_id long, source string, block int, size long, same long, copies long, extra long")
    for part in done:
        filled = filled.unionByName(part)
    return filled


def _sized(docs: DataFrame) -> tuple[DataFrame, list]:
    """Per document its size and block, and a row for each source and block."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), F.xxhash64("text").alias("same"))
    rows = written(rows, "sizes")
    count = [(r.source, blocks_for(r.n)) for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()]
    dealt = rows.join(_blocks(spark, count), F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    dealt = dealt.withColumn("block", _block(F.col("doc_id"), F.col("same"), F.col("blocks"))).drop("blocks")
    return dealt, count


def _blocks(spark, count: list) -> DataFrame:
    return _maybe_broadcast(told(spark, count, "cs string, blocks int"), len(count))


def _block(doc_id: Column, same: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, same, F.lit(SEED)), blocks).cast("int")


def _planned(sized: DataFrame) -> Plan:
    rows = sized.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    return plan([(r.source, r.block, int(r.words), r.n) for r in rows])


def takes(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, the words ``taken``, and by shard as ``shards``.

    ``shards`` lists ``shard:words`` of the shards that the tree has given the document's draws to, by number.
    """
    spark = docs.sparkSession
    sized, _ = _sized(docs)
    made = _planned(sized)
    blocks: dict[tuple[str | None, int], tuple[list[int], list[int]]] = {}
    for source, block, _, shard, part in made.draws:
        blocks.setdefault((source, block), ([], []))[part].append(shard)
    drawn = told(spark, [(s, b, *t) for (s, b), t in blocks.items()], "bs string, bb int, whole array<int>, part array<int>")
    drawn = _maybe_broadcast(drawn, len(blocks))
    on = F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb"))
    plain = sized.join(drawn, on, "left").where("part is null or size(part) = 0")
    last = _last(sized, made).join(drawn, on).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    last = last.withColumn("whole", F.when(F.col("copy") <= F.col("extra"), F.concat("whole", "part")).otherwise(F.col("whole")))
    kept = ["doc_id", "source", "size", "whole"]
    named = _maybe_broadcast(told(spark, made.sources, "ns string, source_size long, target double"), len(made.sources))
    out = plain.select(*kept).unionAll(last.select(*kept)).join(named, F.col("source").eqNullSafe(F.col("ns")), "left")
    by_shard = F.transform(F.array_sort("whole"), lambda x: F.concat_ws(":", x.cast("string"), F.col("size").cast("string")))
    taken = F.coalesce(F.size("whole"), F.lit(0)) * F.col("size")
    shards = F.when(F.col("size") > 0, F.coalesce(F.array_join(by_shard, ","), F.lit(""))).otherwise("")
    return out.select("doc_id", "source", "size", "source_size", "target", F.greatest(taken, F.lit(0)).cast("long").alias("taken"), shards.alias("shards"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken, by shard and shuffled in it, with ``mix_shard`` added."""
    spark = docs.sparkSession
    names = docs.columns
    sized, count = _sized(docs)
    made = _planned(sized)
    last = written(_last(sized, made).where("extra > 0"), "last")
    own, same, size, block, copy, turn, order = free_names(docs, 7)
    rows = docs.withColumns({own: F.col("source").cast("string"), same: F.xxhash64("text"), size: size_of()})
    rows = rows.join(_blocks(spark, count).toDF(f"{own}c", f"{block}c"), F.col(own).eqNullSafe(F.col(f"{own}c")), "left")
    rows = rows.withColumn(block, _block(F.col("doc_id").cast("long"), F.col(same), F.col(f"{block}c")))
    draws = told(spark, made.draws, f"{own}d string, {block}d int, {turn} int, mix_shard int, {order} boolean")
    at = rows.drop("mix_shard").join(_maybe_broadcast(draws, len(made.draws)), F.col(own).eqNullSafe(F.col(f"{own}d")) & (F.col(block) == F.col(f"{block}d")))
    names = [n for n in names if n != "mix_shard"]
    plain = at.where(~F.col(order)).select(*names, "mix_shard", turn)
    alike = Window.partitionBy(F.col("doc_id").cast("long"), own, size, same).orderBy(F.lit(0))
    part = at.where(F.col(order)).withColumn(copy, F.row_number().over(alike))
    chosen = last.select("doc_id", "source", "size", "same", "extra").toDF(*(f"{x}x" for x in (order, own, size, same, copy)))
    keys = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{order}x")) & F.col(own).eqNullSafe(F.col(f"{own}x")) & (F.col(size) == F.col(f"{size}x")) & (F.col(same) == F.col(f"{same}x"))
    part = part.join(chosen, keys).where(F.col(copy) <= F.col(f"{copy}x")).select(*names, "mix_shard", turn)
    out = plain.unionAll(part).withColumn(order, F.xxhash64("doc_id", turn, F.lit(SEED)))
    out = out.repartitionById(max(1, made.shards), "mix_shard") if made.shards >= wide(spark) else out.repartition(2 * wide(spark), "mix_shard")
    return out.sortWithinPartitions("mix_shard", order).drop(order, turn)

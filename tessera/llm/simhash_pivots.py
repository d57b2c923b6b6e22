"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of the
XXH64 values of the text's word shingles.  Hamming distances to a fixed list of
reference fingerprints (the pivots) are precomputed for each different
fingerprint.  By the triangle inequality two fingerprints that differ in at most
``radius`` bits have pivot distances that differ by at most ``radius`` in each
coordinate, so a pair whose largest coordinate difference is greater is
discarded; the survivors are verified by counting their differing bits.

Pivot distances of 64-bit fingerprints lie close together, so the table by itself
would still look at a fixed share of all pairs.  The pairs it looks at are
therefore first restricted to fingerprints that agree on a key:

* ``linked`` uses block combinations.  With ``radius`` differing bits and n
  blocks, n - radius blocks are equal, so one key for each choice of that many
  blocks misses no pair: the result is exact.
* ``similar`` (for a Jaccard threshold, where the radius is too large for that)
  uses keys of sampled bits, whose width and number follow from the number of
  fingerprints, and verifies survivors on the texts' whole shingle sets.  Fingerprints
  of short texts scatter, so some pairs at the threshold lie beyond any useful radius.
  Texts of different groups therefore also meet at the shingles that come first in a
  common order (``shingle_order``): sets with that Jaccard share one of them, so the result is exact.

Equal fingerprints are one class, represented by its smallest ``doc_id``, before
anything is compared: copies never become pairs.  Each task keeps of the links
that it finds in a chunk only a spanning forest, which connects the same
fingerprints, so a group of near copies doesn't become pairs either.  The rows of a
key with more than ``BLOCK`` of them are split into blocks, each two of which meet in a
group of their own, so no task holds a whole hot key.

Defined results: a null text is an empty text; no words give fingerprint zero,
linked like any other; rows with a null ``doc_id`` get the class of their
fingerprint but represent none (a group with no other row has a null
``component_id``); repeated rows keep their rows; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import drop_encoders
from .shared import components, forget, tidy, wide, written
from .shingle_order import HOT, first_keys, hot_shingles
from .shingles import pressed, shingle_hashes, shingle_set

#: Number of pivots, and the seed that their fingerprints come from.
PIVOTS, PIVOT_SEED = 32, 20
#: Pairs that a task expands at once, and rows that it gathers before it compares (the rows of a key come together anyway).
CHUNK, HELD = 100_000, 50_000
#: Rows of a key that a task compares at once; a hot key is split into blocks of about as many.
BLOCK = 50_000
#: Bits of the sketch of a shingle set.
SKETCH = 1024


def vote(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.array([vote(shingle_hashes(t or "", size)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (unsigned 64-bit) to the pivots, one column for each."""
    pivots = np.random.default_rng(PIVOT_SEED).integers(0, 1 << 64, PIVOTS, np.uint64, endpoint=False)
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def close_pairs(keys: np.ndarray, fp: np.ndarray, radius: int, side: np.ndarray | None = None):
    """Yield arrays (i, j, distance) of the rows with equal keys whose fingerprints are within ``radius``.

    With ``side``, rows of side 0 and 1 meet only each other.

    Rows are put in order of key and first pivot distance; the partners of a row
    stand in the window of its key up to ``radius`` further on that axis.  The
    other coordinates then discard pairs, and the rest is verified.
    """
    table = pivot_table(fp)
    _, rank = np.unique(keys, return_inverse=True)
    axis = rank.astype(np.int64) * 256 + table[:, 0]
    order = np.argsort(axis, kind="stable")
    axis, table, own = axis[order], table[order], fp[order]
    stop = np.searchsorted(axis, axis + radius, "right")
    start = np.arange(len(axis)) + 1
    room = stop - start
    total = np.cumsum(room)
    at = 0
    while at < len(axis):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        n = room[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:end], n)
        for k in range(1, PIVOTS):
            if len(i) < 64:
                break
            low = np.abs(table[i, k].astype(np.int8) - table[j, k].astype(np.int8)) <= radius
            i, j = i[low], j[low]
        d = np.bitwise_count(own[i] ^ own[j])
        near = d <= radius
        i, j, d = order[i[near]], order[j[near]], d[near]
        if side is not None:
            apart = (side[i] == BOTH) | (side[i] != side[j])
            i, j, d = i[apart], j[apart], d[apart]
        yield i, j, d
        at = end


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each node, that connect the same nodes as the given links."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the closest one of a smaller id, of equally close ones the smallest, and its distance."""
    high, low = np.where(ids[i] > ids[j], i, j), np.where(ids[i] > ids[j], j, i)
    order = np.lexsort((ids[low], d, high))
    high, low, d = high[order], low[order], d[order]
    first = np.ones(len(high), bool)
    first[1:] = high[1:] != high[:-1]
    return high[first], low[first], d[first]


#: Side of a row whose block meets itself, or whose key isn't split.
BOTH = 2


def dealt(keyed: DataFrame, node: str) -> DataFrame:
    """Rows by ``key`` in key order, with ``side``; those of a hot key once for each block that theirs meets.

    The group of two blocks gets a key of its own.  Should two groups' keys agree, their
    rows are compared with each other too, which loses nothing.
    """
    spark = keyed.sparkSession
    hot = written(keyed.groupBy("key").count().where(F.col("count") > BLOCK), "hot-keys")
    names = keyed.columns
    if hot.isEmpty():
        met = keyed.withColumn("side", F.lit(BOTH))
    else:
        hot = hot.select(F.col("key").alias("hk"), F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
        at = keyed.join(hot, F.col("key") == F.col("hk"), "left").withColumn("own", F.pmod(F.xxhash64(node, F.lit(1)), "blocks"))
        side = lambda o: F.when(o == F.col("own"), BOTH).when(o > F.col("own"), 0).otherwise(1)
        group = lambda o: F.xxhash64("key", F.least(o, "own"), F.greatest(o, "own"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(group(o).alias("key"), side(o).alias("side")))
        alone = F.array(F.struct(F.col("key"), F.lit(BOTH).alias("side")))
        at = at.withColumn("met", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)))
        met = at.select(*[F.col("met.key") if n == "key" else F.col(n) for n in names], "met.side")
    return met.repartition(2 * wide(spark), "key").sortWithinPartitions("key")


def by_whole_keys(compare):
    """A function for mapInArrow over rows in order of their first column, a key: ``compare`` gets arrays with whole keys."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            part = [_sketches(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(part[0]):
                continue
            held.append(part)
            rows += len(part[0])
            if rows < HELD or held[0][0][0] == part[0][-1]:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            yield from compare(*[x[:cut] for x in whole])
            held, rows = [[x[cut:] for x in whole]], len(whole[0]) - cut
        if held:
            yield from compare(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _search(radius: int, by_nearest: bool):
    """A function for mapInArrow over rows (key, fp, rep, side) in key order: links (a, b, d) between reps."""

    def links(keys, fp, rep, side):
        for i, j, d in close_pairs(keys, fp.view(np.uint64), radius, side):
            if len(i):
                a, b, far = nearest(i, j, d, rep) if by_nearest else (*forest(i, j), None)
                far = pa.nulls(len(a), pa.int32()) if far is None else pa.array(far.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b]), far], names=["a", "b", "d"])

    return by_whole_keys(links)


def block_masks(radius: int, n: int) -> list[int]:
    """Masks of the block choices of which one is equal in any two fingerprints within ``radius``.

    More fingerprints get more and wider keys, so that few others share one; every
    choice misses nothing.
    """
    free = 1
    while free < 3 and 64 * free // (radius + free) < log2(max(n, 2)) - 7:
        free += 1
    cuts = [64 * k // (radius + free) for k in range(radius + free + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, free)]


def sampled_masks(angle: float, n: int, miss: float = 0.02) -> list[int]:
    """Masks of sampled bits: at ``angle`` (share of differing bits) a pair shares a key but for ``miss``."""
    width = min(28, max(10, ceil(log2(max(n, 2))) - 2))
    tables = ceil(log2(miss) / log2(1 - (1 - angle) ** width))
    rng = np.random.default_rng(width)
    return [sum(1 << int(k) for k in rng.choice(64, width, replace=False)) for _ in range(tables)]


def candidate_links(classes: DataFrame, masks: list[int], radius: int, by_nearest: bool) -> DataFrame:
    """Links (a, b) between classes (``rep``, ``fp``) that share a masked fingerprint and are within ``radius``.

    By nearest, ``d`` is their distance.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    keyed = classes.select(F.explode(keys).alias("key"), "fp", "rep")
    return dealt(keyed, "rep").mapInArrow(_search(radius, by_nearest), "a long, b long, d int")


def classes_of(prints: DataFrame) -> DataFrame:
    """One row for each different fingerprint: its smallest ``doc_id`` as ``rep``."""
    return prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))


def linked(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """Per document: ``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` reachable by links.

    Two texts link if their fingerprints differ in at most ``radius`` bits.  Exact.
    """
    prints = written(fingerprints(docs, size), "prints")
    classes = written(classes_of(prints), "classes")
    links = written(candidate_links(classes, block_masks(radius, classes.count()), radius, False), "links")
    roots = components(links)
    forget(links)
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def sketch(own: np.ndarray) -> bytes:
    """Parities of the shingles by the low bits of their hashes.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    return np.packbits(np.bincount((own % SKETCH).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH // 64)


def _differ(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of rows i and j, some of them at once."""
    step = 1 << 15
    parts = [np.bitwise_count(sketches[i[k : k + step]] ^ sketches[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def may_reach(n: np.ndarray, m: np.ndarray, differ: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` that differ in at least ``differ`` shingles may have a Jaccard of ``threshold``."""
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-9)


def text_name():
    """A name (long) for the text in ``text``, the same for equal texts; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))))


def _described(docs: DataFrame, size: int) -> DataFrame:
    """Per document what the search needs of its text; and rows ``hash, count`` of shingles frequent in a batch of texts.

    ``same`` names the text, ``size`` is that of its shingle set, ``text`` is compressed.
    """
    names = ["doc_id", "same", "size", "fp", "sketch", "text", "hash", "count"]

    def run(batches):
        drop_encoders()
        tidy()
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(2)]
            fp, n, sketches = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), []
            once: dict[str, np.ndarray] = {}
            for k, t in enumerate(texts):
                hashes = shingle_hashes(t, size)
                own = np.unique(hashes)
                fp[k], n[k] = vote(hashes), len(own)
                sketches.append(sketch(own))
                once[t] = own
            rows = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(fp.view(np.int64)), pa.array(sketches, pa.binary()), pa.array([pressed(t) for t in texts], pa.binary()), rows, rows], names=names)
            hashes, count = np.unique(np.concatenate([*once.values(), np.zeros(0, np.uint64)]), return_counts=True)
            on = count >= max(3, HOT / 2 * len(once))
            none = lambda kind: pa.nulls(int(on.sum()), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*[none(pa.int64())] * 4, none(pa.binary()), none(pa.binary()), pa.array(hashes[on].view(np.int64)), pa.array(count[on])], names=names)

    return docs.mapInArrow(run, "doc_id long, same long, size long, fp long, sketch binary, text binary, hash long, count long")


def unlinked_pairs(key, node, group, size, place, side, threshold: float):
    """Yield arrays (i, j) of rows with equal keys and different groups that may reach ``threshold``.

    Rows of the group that has most rows of a key are not compared with each other, so large
    groups cost nothing.  Sizes must be in proportion, and as many shingles as needed must be
    left from the places on.
    """
    big = np.int64(1) << 40
    _, rank = np.unique(key, return_inverse=True)
    order = np.lexsort((size, rank))
    rank, group, size, place, side = rank[order].astype(np.int64), group[order], size[order], place[order], side[order]
    by = np.lexsort((group, rank))
    change = np.ones(len(by), bool)
    change[1:] = (np.diff(rank[by]) != 0) | (np.diff(group[by]) != 0)
    run = np.cumsum(change) - 1
    length = np.bincount(run)
    run_rank = rank[by][change]
    largest = np.lexsort((length, run_rank))
    last = np.ones(len(largest), bool)
    last[:-1] = np.diff(run_rank[largest]) != 0
    main = np.zeros(len(length), bool)
    main[largest[last]] = True
    major = np.zeros(len(by), bool)
    major[by] = main[run]
    axis = rank * big + size
    minor = np.flatnonzero(~major)
    start = np.searchsorted(axis, rank[minor] * big + np.ceil(threshold * size[minor] - 1e-9).astype(np.int64), "left")
    room = np.searchsorted(axis, rank[minor] * big + np.floor(size[minor] / threshold + 1e-9).astype(np.int64), "right") - start
    total = np.cumsum(room)
    at = 0
    while at < len(minor):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        n = room[at:end]
        i = np.repeat(minor[at:end], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:end], n)
        left = np.minimum(size[i] - place[i], size[j] - place[j])
        fit = (group[i] != group[j]) & (major[j] | (i < j)) & ((side[i] == BOTH) | (side[i] != side[j]))
        fit &= left >= threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9
        yield order[i[fit]], order[j[fit]]
        at = end


def _unlinked(threshold: float, closest: bool):
    """Pairs (a, b) of rows (key, node, group, size, place, sketch, side) whose sketches let them reach ``threshold``.

    With ``closest``, of each two groups that meet at a key in a chunk only the pair whose sketches are closest.
    """

    def pairs(key, node, group, size, place, sketches, side):
        for i, j in unlinked_pairs(key, node, group, size, place, side, threshold):
            differ = _differ(sketches, i, j)
            on = may_reach(size[i], size[j], differ, threshold)
            i, j, differ = i[on], j[on], differ[on]
            if closest and len(i):
                low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                order = np.lexsort((differ / (size[i] + size[j]), high, low))
                first = np.ones(len(order), bool)
                first[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
                i, j, differ = i[order][first], j[order][first], differ[order][first]
            if len(i):
                far = differ / (size[i] + size[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j])), pa.array(far)], names=["a", "b", "far"])

    return by_whole_keys(pairs)


def _likely(links: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) that sizes and sketches let reach ``threshold``."""

    def run(batches):
        for b in batches:
            n, m = (b.column(k).to_numpy() for k in (2, 4))
            differ = np.bitwise_count(_sketches(b.column(3)) ^ _sketches(b.column(5))).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(may_reach(n, m, differ, threshold)))

    both = links.select("a", "b").join(prints.toDF("a", "na", "sa"), "a").join(prints.toDF("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _reaching(size: int, threshold: float):
    """A function for mapInArrow over rows (a, b, text of a, text of b): the (a, b) whose shingle sets reach ``threshold``."""

    def reach(x: bytes, y: bytes) -> bool:
        u, v = shingle_set(x, size), shingle_set(y, size)
        common = len(u) + len(v) - len(np.union1d(u, v)) if min(len(u), len(v)) >= threshold * max(len(u), len(v)) else 0
        return common >= threshold * (len(u) + len(v) - common)

    def run(batches):
        for b in batches:
            on = [reach(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    return run


def _verified(texts: DataFrame, links: DataFrame, size: int, threshold: float) -> DataFrame:
    """The links (a, b) whose whole shingle sets reach ``threshold``; ``texts`` has ``node`` and ``text``."""
    left = links.join(texts.toDF("a", "ta"), "a")
    right = texts.toDF("b", "tb").join(links.select("b").distinct(), "b", "left_semi")
    both = left.join(right, "b").select("a", "b", "ta", "tb")
    return written(both.mapInArrow(_reaching(size, threshold), "a long, b long"), "sure")


def _across(keyed: DataFrame, prints: DataFrame, roots: DataFrame, threshold: float, closest: bool) -> DataFrame:
    """Pairs (a, b, far) of nodes that share a key, aren't in the same group and may reach ``threshold``."""
    met = keyed.join(roots, "node", "left").join(prints.select("node", "sketch"), "node")
    met = met.select("key", "node", F.coalesce("root", "node").alias("group"), "size", "place", "sketch")
    return dealt(met, "node").mapInArrow(_unlinked(threshold, closest), "a long, b long, far double")


def similar(docs: DataFrame, size: int = 5, threshold: float = 0.8, slack_bits: int = 4) -> DataFrame:
    """Per document: ``doc_id`` and ``component_id`` by links of texts whose shingle sets have a Jaccard of ``threshold``.

    ``same`` is the text's name, ``first`` marks the row that stands for its group: of those with its smallest
    ``doc_id`` the text with the smallest name (of a group without any id the same); repeated rows are all marked.

    The radius of the search is the expected distance at the threshold plus
    ``slack_bits``.  Of the survivors that share a key, each class is linked to its
    closest earlier one, and these links are verified on the
    whole shingle sets.  Texts that this leaves in different groups are then brought together
    by their first shingles (``shingle_order``); of any two groups first the closest pair is verified,
    then every pair whose groups are still apart, so no link between groups is lost.
    Sketches discard most pairs before their texts are fetched, and never one at the threshold.
    Classes of equal fingerprints whose texts differ are compared like any others.
    """
    cosine = 2 * threshold / (1 + threshold)
    angle = float(np.arccos(cosine) / np.pi)
    radius = round(64 * angle) + slack_bits
    described = written(_described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("same"), "text"), size), "described")
    members = written(described.where("same is not null").select("doc_id", "same"), "members")
    firsts = members.groupBy("same").agg(F.min("doc_id").alias("rep"))
    # any row of a text will do; copies go before they are exchanged
    own = described.where("same is not null").select(F.col("same").alias("node"), "size", "fp", "sketch", "text")
    unique = written(own.dropDuplicates(["node"]), "texts")
    texts, prints = unique.select("node", "text"), unique.select("node", "size", "sketch")

    n, shingles = unique.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    masks = sampled_masks(angle, n)
    links = candidate_links(unique.select(F.col("node").alias("rep"), "fp"), masks, radius, True).groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
    links = written(_likely(links.select("a", "m.b"), prints, threshold), "links")
    sure = [_verified(texts, links, size, threshold)]
    roots = written(components(sure[0]), "roots")

    hot = hot_shingles(described.where("hash is not null").select("hash", "count"), n, shingles)
    keyed = written(first_keys(texts, size, threshold, shingles, hot), "keyed")
    # of two groups first the closest pair: it joins most of them, and what is joined needs no other pair
    met = _across(keyed, prints, roots, threshold, True).join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    met = met.withColumns({"ga": F.coalesce("ra", "a"), "gb": F.coalesce("rb", "b")})
    best = met.groupBy(F.least("ga", "gb"), F.greatest("ga", "gb")).agg(F.min(F.struct("far", "a", "b")).alias("m"))
    best = written(best.select("m.a", "m.b"), "best")
    sure.append(_verified(texts, best, size, threshold))
    joined = written(components(sure[1].unionAll(roots.toDF("a", "b"))), "roots")
    left = _across(keyed, prints, joined, threshold, False).select("a", "b").distinct().join(best, ["a", "b"], "left_anti")
    left = written(left, "left")
    sure.append(_verified(texts, left, size, threshold))
    found = components(sure[2].unionAll(joined.toDF("a", "b")))
    for table in (described, unique, links, roots, keyed, best, joined, left, *sure):  # what is returned reads none of these
        forget(table)
    named = firsts.join(found, firsts.same == found.node, "left").select("same", "rep", F.coalesce("root", "same").alias("group"))
    lowest = named.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "same")).alias("low"))
    named = named.join(lowest, "group").select("same", F.col("low.rep").alias("component_id"), F.col("low.same").alias("low"))
    first = (F.col("same") == F.col("low")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return members.join(named, "same", "left").select("doc_id", "component_id", "same", first.alias("first"))

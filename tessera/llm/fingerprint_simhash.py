"""Document fingerprints: SimHash with permuted block tables, in DataFrame functions alone.

A text's terms are its word triples (texts of fewer words: the whole sequence).
Each occurrence of a term votes, so a term weighs as often as it occurs: it adds one to
each bit that its hash has and takes one from the others.  The fingerprint has
128 bits, the signs of the sums, in two longs from two chained XXH64 hashes.

Terms are exploded and their votes summed by generated code, two bits to a long in lanes of
32 bits.  Sums are grouped where the rows already lie, so votes are never shuffled.

Permuted block tables find all fingerprints within a Hamming radius: the bits are cut into
blocks, and one table for each choice of blocks brings together the fingerprints that
agree there; fingerprints within the radius agree in at least one choice, so none is lost.  More fingerprints get wider keys
and more tables, so that few others share one.  Equal fingerprints are one class.  The classes of a key are compared inside one
row, which gives each of them a count and a smallest id and no pairs; a key with more than ``KEY`` of them
is split into blocks, each two of which meet in a row of their own.

Defined results: a null text is an empty text; without terms all bits are zero;
equal texts have equal fingerprints and a likeness of 1; rows with equal ``doc_id`` follow
each other by a hash of their text; a null ``doc_id`` stands first; the next of
a single document is itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, isqrt, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import wide, written

#: Lanes of 32 bits in a long: bits k and k + 32 of a hash.
LANES = 0x0000000100000001
#: Bits of a fingerprint, the radius that neighbours lie within, and classes of a key that are compared in a row.
BITS, RADIUS, KEY = 128, 3, 256
#: White space that separates words.
SPACE = " \t\n\x0b\f\r"


def terms(text: Column) -> Column:
    """Hashes of the text's word triples, repeats included, as an array of long."""
    words = F.split(F.lower(F.btrim(text, F.lit(SPACE))), r"[\x20\x09-\x0D]+")

    def hashed(w: Column) -> Column:
        n = F.size(w)
        triples = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2)),
        )
        none = (n == 1) & (F.get(w, F.lit(0)) == "")
        return F.when(none, F.array().cast("array<bigint>")).when(n < 3, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(triples)

    return F.element_at(F.transform(F.array(words), hashed), 1)  # words are computed once


def voted(rows: DataFrame, keys: list[str], hashes: Column) -> DataFrame:
    """``keys`` and the fingerprint ``fp`` (a struct of the longs ``a`` and ``b``) of the votes of each key's rows."""
    each = rows.select(*keys, F.explode_outer(hashes).alias("h")).withColumn("g", F.when(F.col("h").isNotNull(), F.xxhash64("h")))
    sums = [F.expr(f"sum(shiftrightunsigned({x}, {k}) & {LANES}L)").alias(f"{x}{k}") for x in "hg" for k in range(32)]
    counted = each.groupBy(*keys).agg(F.count("h").alias("n"), *sums)

    def signs(x: str) -> str:
        low = [f"IF(2 * ({x}{k} & 4294967295L) > n, shiftleft(1L, {k}), 0L)" for k in range(32)]
        high = [f"IF(2 * shiftrightunsigned({x}{k}, 32) > n, shiftleft(1L, {k + 32}), 0L)" for k in range(32)]
        return " | ".join(low + high)

    return counted.select(*keys, F.expr(f"named_struct('a', {signs('h')}, 'b', {signs('g')})").alias("fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` of every whole text; rows equal in both give one row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return voted(rows.withColumn("tie", F.xxhash64("text")), ["doc_id", "tie"], terms(F.col("text"))).drop("tie")


def shown(fp: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(fp[x])), 16, "0") for x in ("a", "b")])


def distance(x: Column, y: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(x["a"].bitwiseXOR(y["a"])) + F.bit_count(x["b"].bitwiseXOR(y["b"]))


def likeness(x: Column, y: Column) -> Column:
    """Cosine that the differing bits stand for, 0 to 1: 1 for equal fingerprints, near 0 for unrelated ones."""
    d = distance(x, y)
    return F.when(d >= BITS // 2, F.lit(0.0)).when(d == 0, F.lit(1.0)).otherwise(F.cos(d * F.lit(3.141592653589793 / BITS)))


def _below(bounds: list[int], x: Column, equal: bool = False) -> Column:
    """How many of the sorted bounds are below ``x`` (or equal to it), by looking at about twice the root of their number."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731 - folded to one literal
    under = lambda b: b <= x if equal else b < x
    heads = F.size(F.filter(constant(bounds[::step]), under))
    rest = F.size(F.filter(F.slice(constant(bounds), F.greatest(heads - 1, F.lit(0)) * step + 1, F.lit(step)), under))
    return F.greatest(heads - 1, F.lit(0)) * step + rest


def in_ranges(rows: DataFrame) -> DataFrame:
    """Rows dealt to ranges of ``doc_id`` (column ``range``), each with a guest: the first row of the next range that has rows.

    Only the bounds and each range's first id come to the driver; ``tie`` orders equal ids.  An id that
    has the rows of several ranges, and null ids, are cut into as many by ``tie``.
    """
    spark = rows.sparkSession
    n = 4 * wide(spark)
    seen = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("b"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    bounds, nulls = sorted(seen.b or []), ceil(n * (seen.n - seen.known) / max(seen.n, 1))
    first = _below(bounds, F.col("doc_id"))
    parts = F.when(F.col("doc_id").isNull(), F.lit(nulls)).otherwise(_below(bounds, F.col("doc_id"), True) - first + 1)
    of_tie = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts)
    within_id = F.least(F.greatest(of_tie, F.lit(0)), parts - 1).cast("int")
    rows = rows.withColumn("range", (F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(first + nulls) + within_id).cast("int"))
    lowest = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("low")
    firsts = sorted((r.range, r.low.doc_id, r.low.tie) for r in rows.groupBy("range").agg(lowest).collect())
    guests = [(*f, firsts[k - 1][0]) for k, f in enumerate(firsts)]
    seen = F.broadcast(spark.createDataFrame(guests, "g_range int, g_id long, g_tie long, to int"))  # one row for each range
    lent = rows.join(seen, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    lent = lent.dropDuplicates(["range", "doc_id", "tie"]).withColumn("range", F.col("to")).select(*rows.columns)
    return rows.withColumn("guest", F.lit(0)).unionAll(lent.withColumn("guest", F.lit(1)))


def compared(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like both and the next document's are.

    ``n_within`` counts the other documents whose fingerprints are within ``RADIUS`` of its own, and ``lowest_within``
    is the smallest ``doc_id`` among them and itself.

    Texts are shuffled once, to ranges of ``doc_id``; the next document's text and
    fingerprint, the votes and their sums are all found inside a range.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    rows = in_ranges(rows).withColumns({"next_text": F.lead("text").over(order), "at": F.row_number().over(order)})
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("own")), F.struct(F.lit(1).alias("side"), edited.alias("own")))
    both = rows.select("range", "at", "doc_id", "guest", n.alias("n_chars"), F.explode(sides).alias("s"))
    # all keys are numbers, so the sums need no sort
    sha = F.sha2("s.own", 256)
    quarters = [F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    keys = ["range", "at", "doc_id", "guest", "n_chars", "side", "sha0", "sha1", "sha2", "sha3"]
    prints = voted(both.select("range", "at", "doc_id", "guest", "n_chars", "s.side", *quarters, "s.own"), keys, terms(F.col("own")))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c.replace('.', '')}{side}")
    picked = [*(pick(1, k) for k in keys[-4:]), *(pick(side, c) for side in (0, 1) for c in ("fp.a", "fp.b"))]
    one = prints.groupBy("range", "at", "doc_id", "guest", "n_chars").agg(*picked)
    fp, edited_fp = (F.struct(F.col(f"fpa{side}").alias("a"), F.col(f"fpb{side}").alias("b")) for side in (0, 1))
    one = one.select("range", "at", "guest", "doc_id", "n_chars", F.concat(*[F.lpad(F.lower(F.hex(f"sha{k}1")), 16, "0") for k in range(4)]).alias("edited_sha256"), fp.alias("fp"), edited_fp.alias("edited_fp"))
    one = one.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("range").orderBy("at"))).where("guest = 0")
    one = written(one.drop("range", "at", "guest"), "compared")
    near = neighbours(one.select("doc_id", "fp"))
    one = one.join(near, (F.col("fp.a") == F.col("na")) & (F.col("fp.b") == F.col("nb")), "left")
    return one.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
        "lowest_within",
    )


def block_cuts(radius: int, free: int) -> list[int]:
    """Masks of the ``radius + free`` blocks that the 128 bits are cut into."""
    n = radius + free
    cuts = [BITS * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def free_blocks(radius: int, classes: int) -> int:
    """Blocks of a key: as many as keep its bits over those that number the classes, three at most; any number loses nothing."""
    free = 1
    while free < 3 and BITS * free // (radius + free) < log2(max(classes, 2)) + 4:
        free += 1
    return free


def _longs(mask: int) -> tuple[int, int]:
    high, low = mask >> 64, mask & ((1 << 64) - 1)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (high, low))


def neighbours(prints: DataFrame, radius: int = RADIUS, free: int | None = None) -> DataFrame:
    """Per different fingerprint (``na``, ``nb``): the other documents within ``radius`` and the smallest id of all of them.

    ``prints`` has ``doc_id`` and ``fp``, a row for each document.
    """
    classes = prints.groupBy(F.col("fp.a").alias("a"), F.col("fp.b").alias("b")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"))
    classes = written(classes, "classes")
    free = free or free_blocks(radius, classes.count())
    blocks = [_longs(m) for m in block_cuts(radius, free)]
    choices = list(combinations(range(len(blocks)), free))
    whole = [_longs(sum(c)) for c in combinations(block_cuts(radius, free), free)]
    masked = lambda k, c: F.col(c).bitwiseAND(F.lit(whole[k][0 if c == "a" else 1]))
    tables = F.array(*[F.struct(F.lit(k).alias("t"), masked(k, "a").alias("x"), masked(k, "b").alias("y")) for k in range(len(choices))])
    key = ["t", "x", "y"]
    keyed = classes.select("a", "b", "rep", "w", F.explode(tables).alias("k")).select("a", "b", "rep", "w", "k.*")
    full = written(keyed.groupBy(*key).count().where("count > 1"), "keys")
    # only keys that several classes share; a hot one is cut into blocks
    full = full.select(*[F.col(c).alias(f"k{c}") for c in key], F.ceil(F.col("count") / KEY).cast("int").alias("parts"))
    met = keyed.join(full, [F.col(c) == F.col(f"k{c}") for c in key]).withColumn("own", F.pmod(F.xxhash64("a", "b"), "parts").cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(other, lambda o: F.struct(F.least(o, "own").alias("p"), F.greatest(o, "own").alias("q"), F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1).alias("side")))
    met = met.select("a", "b", "rep", "w", *key, F.explode(pairs).alias("m"))
    rows = met.groupBy(*key, "m.p", "m.q").agg(F.collect_list(F.struct("a", "b", "rep", "w", F.col("m.side").alias("side"))).alias("m")).where(F.size("m") > 1)

    # the table in which two classes count: the first choice of blocks that they agree in
    ordered = [F.lit(k) for k in range(len(choices))]

    def first_table(x: Column, y: Column) -> Column:
        same = [(x["a"].bitwiseXOR(y["a"]).bitwiseAND(F.lit(m[0])) == 0) & (x["b"].bitwiseXOR(y["b"]).bitwiseAND(F.lit(m[1])) == 0) for m in blocks]
        agree = [same[c[0]] if free == 1 else same[c[0]] & same[c[1]] if free == 2 else same[c[0]] & same[c[1]] & same[c[2]] for c in choices]
        return F.coalesce(*[F.when(on, k) for on, k in zip(agree, ordered, strict=True)])

    def seen(x: Column) -> Column:
        meets = lambda y: ((x["side"] == 2) | (x["side"] != y["side"])) & distance(x, y).between(1, radius)
        near = F.filter(F.filter(F.col("m"), meets), lambda y: first_table(x, y) == F.col("t"))
        told = lambda n: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.aggregate(n, F.lit(0).cast("long"), lambda s, y: s + y["w"]).alias("n"), F.array_min(F.transform(n, lambda y: y["rep"])).alias("low"))
        return F.element_at(F.transform(F.array(near), told), 1)

    found = rows.select("t", "m").select(F.explode(F.filter(F.transform("m", seen), lambda x: x["n"] > 0)).alias("x")).select("x.*")
    found = found.groupBy(F.col("a").alias("fa"), F.col("b").alias("fb")).agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    all_ = classes.join(found, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left")
    n = (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long")
    return all_.select(F.col("a").alias("na"), F.col("b").alias("nb"), n.alias("n_within"), F.least("rep", "low").alias("lowest_within"))


def within(prints: DataFrame, radius: int = 6, free: int = 2) -> DataFrame:
    """All pairs of different fingerprints within ``radius``: ``low_id``, ``high_id``, ``distance``.

    ``prints`` has ``doc_id`` and ``fp``.  Documents with equal fingerprints are one class, named
    by its smallest ``doc_id`` (membership is equality of fingerprints); pairs are of classes.  For few pairs: there are as many
    as a group has, so ``neighbours`` is for tables with large ones.
    """
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    signed = [_longs(sum(c)) for c in combinations(block_cuts(radius, free), free)]
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp.a").bitwiseAND(F.lit(a)).alias("x"), F.col("fp.b").bitwiseAND(F.lit(b)).alias("y")) for k, (a, b) in enumerate(signed)])
    keyed = classes.select("fp", "rep", F.explode(tables).alias("key")).select("fp", "rep", "key.*")
    left, right = keyed.toDF("fp1", "rep1", "t", "x", "y"), keyed.toDF("fp2", "rep2", "t", "x", "y")
    pairs = left.join(right, ["t", "x", "y"]).where("rep1 < rep2").withColumn("distance", distance(F.col("fp1"), F.col("fp2")))
    pairs = pairs.where(F.col("distance") <= radius)
    return pairs.select(F.col("rep1").alias("low_id"), F.col("rep2").alias("high_id"), "distance").distinct()

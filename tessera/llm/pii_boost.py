"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Patterns of the fixed base kinds give spans that always stay.  High-recall generators propose
further, overlapping spans: long tokens, values (quoted or not) after a word such as ``password``, numbers with
separators, and codes in groups.  Boosted trees score every candidate by its format and the characters
before it, and others tell secrets from identifiers; selected candidates that overlap are one span, of the kind of the one that scored highest.  The trees were
grown on a labelled table that ``examples`` builds from a rule, and the
threshold of each kind, which selects redactions, was calibrated on the half of it that they did not
see.  The trees reach the executors as expressions, so the texts never leave the JVM.

Patterns are written so that they take linear time: a match can only begin where a
run of its characters begins or where the last match ended, and loops give nothing back.  Places, overlaps and
replacements go through the matches once, in order (``gathered``), so a text with many of them takes time in proportion.

Defined results: a null text is an empty text; no spans give empty strings and the hash
of the empty string; repeated rows are scanned each; an empty table gives no rows; further columns are
ignored by ``found`` and kept by ``redacted``.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names

#: Base kinds in their order and their patterns.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds, in their order behind the base kinds.
ADDED = ("secret", "id")
#: Characters before a candidate that its context features see.
CONTEXT = 32
#: Words before a value that make it a secret or an identifier.
SECRET = r"(?:token|passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?key|bearer|credential)s?"
ID = r"(?:ssn|social security|passport|iban|account|tax id|national id|driver)(?: (?:no|number|nr))?"
SECRET_WORDS = rf"(?i){SECRET}[\"'\s]{{0,3}}[=:]?[\"'\s]{{0,3}}$"
ID_WORDS = rf"(?i){ID}[.\"'\s:#=]{{0,4}}$"
#: Generators of candidates: long tokens; values after words, bare and quoted; separated numbers; codes in groups.
TOKEN = r"(?:\G|(?<![A-Za-z0-9_/+-]))[A-Za-z0-9_/+-]{9,}+={0,2}"
_BARE = r"[^\s\"'=:#<>,;.)\]](?:[^\s\"'<>,;]*[^\s\"'<>,;.:)\]])?"
GENERATORS = {
    "token": TOKEN,
    "secret_value": rf"(?<=[\s\"'=:])(?<=(?i:{SECRET})[\"'\s]{{0,3}}[=:]?[\"'\s]{{0,3}}){_BARE}",
    "id_value": rf"(?<=[.\"'\s:#=])(?<=(?i:{ID})[.\"'\s:#=]{{0,4}}){_BARE}",
    "quoted": rf"(?<=\")(?<=(?i:{SECRET})[\"']?\s{{0,2}}[=:]\s{{0,2}}\")[^\"\n]++(?=\")|(?<=')(?<=(?i:{SECRET})[\"']?\s{{0,2}}[=:]\s{{0,2}}')[^'\n]++(?=')",
    "number": r"(?<![A-Za-z0-9])[0-9]++(?:[\x20./-][0-9]++)++(?![A-Za-z0-9])",
    "triple": r"(?<![A-Za-z0-9])[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}(?![A-Za-z0-9])",
    "groups": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a generator to find anything in it: one of these words, in any case, or a match of a pattern.
_SECRET_PARTS = ("token", "passw", "pwd", "secret", "api", "access", "bearer", "credential")
_ID_PARTS = ("ssn", "social security", "passport", "iban", "account", "tax id", "national id", "driver")
NEEDED = {
    ("token",): None, ("secret_value", "quoted"): _SECRET_PARTS, ("id_value",): _ID_PARTS,
    ("number",): r"[0-9][\x20./-][0-9]", ("triple",): r"[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}", ("groups",): "[A-Z]{2}[0-9]{2}",
}
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,text:string>"
CANDIDATE = "struct<start:int,end:int,text:string,before:string>"
#: Elements that an array grows by, and code points of a block that pieces of a text are cut from.
GROW, BLOCK = 64, 1024


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gathered(items: Column, state: Column, kind: str, step) -> Column:
    """A struct of the last ``state`` and ``outs``: ``step(state, item)`` gives a struct of the next ``state`` and an ``out`` of type ``kind``.

    An array is copied when it grows, so results are gathered in short arrays that are put together at the end.
    """

    def one(acc: Column, item: Column) -> Column:
        return _let(step(acc["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def over(whole: Column) -> Column:
        def part(acc: Column, k: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("outs"))
            more = lambda x: F.struct(x["state"].alias("state"), F.concat(acc["parts"], F.array(x["outs"])).alias("parts"))
            return F.aggregate(F.slice(whole, k * GROW + 1, F.lit(GROW)), zero, one, more)

        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
        parts = F.when(F.size(whole) > 0, F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / GROW).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(parts, zero, part, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["parts"]).alias("outs")))

    return _let(items, over)


def _told(state: Column, out: Column) -> Column:
    return F.struct(state.alias("state"), out.alias("out"))


def blocks_of(text: Column) -> Column:
    """A text in blocks, from which ``piece`` cuts without going through what stands before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, length: Column) -> Column:
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(length, F.lit(1)) - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, length)


def _holds(text: Column, needed: str | tuple[str, ...]) -> Column:
    if isinstance(needed, str):
        return text.rlike(needed)
    return _let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in needed]))


def _pairs(text: Column, pattern: str) -> Column:
    """Matches of a pattern, each with the gap before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return _let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))))


def matches(text: Column, pattern: str, kind: str, number: int) -> Column:
    """All matches of a pattern with their places in code points (end exclusive)."""

    def step(at: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("text"))
        return _told(end, one)

    return gathered(_pairs(text, pattern), F.lit(0), SPAN, step)["outs"]


def candidates(text: Column, pattern: str) -> Column:
    """All matches of a generator with their places and the characters before them."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])

        def with_before(before: Column) -> Column:
            one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"), before.alias("before"))
            tail = F.substring(F.concat(before, pair["hit"]), -CONTEXT, CONTEXT)
            return _told(F.struct(end.alias("at"), tail.alias("tail")), one)

        return _let(F.substring(F.concat(state["tail"], pair["gap"]), -CONTEXT, CONTEXT), with_before)

    return gathered(_pairs(text, pattern), zero, CANDIDATE, step)["outs"]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(k: Column) -> Column:
        v = F.substring(d, F.length(d) - k, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(k % 2 == 1, twice).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, k: a + worth(k))
    return total % 10 == 0


def _valid(span: Column, kind: str) -> Column:
    text = span["text"]
    if kind == "ip":
        parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        d = digits(text)
        return F.length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits(text)).between(10, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda s: _valid(s, kind)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    # what a text must hold for a kind to be in it
    cheap = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}
    each = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        own = F.filter(matches(text, pattern, kind, k), _validity(kind))
        each.append(F.when(cheap[kind], own).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.sort_array(F.concat(*each))


#: Features of a candidate, in the order of the trees' feature numbers.
FEATURES = ("length", "digit_share", "upper_share", "lower_share", "mark_share", "variety", "hex", "known_form", "number_form", "after_secret_word", "after_id_word", "distinct", "space_share", "assigned")
#: Forms that stand for themselves: access key ids and the like; number forms of identity codes.
KNOWN_FORM = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^sk[_-][A-Za-z0-9_-]{16,}$|^eyJ[A-Za-z0-9_-]{10,}$"
NUMBER_FORM = r"^[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}$|^[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}$"
#: A value that is assigned to what stands before it.
ASSIGNED = r"[=:][\"'\s]*$"


def features_of(text: str, before: str) -> list[float]:
    """Features of a candidate, as the expressions of ``feature_columns`` compute them."""
    n = len(text)
    share = lambda p: len(re.findall(p, text)) / n
    return [
        float(n), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"), len(set(text)) / n,
        float(bool(re.search("^[0-9a-f]+$|^[0-9A-F]+$", text))), float(bool(re.search(KNOWN_FORM, text))), float(bool(re.search(NUMBER_FORM, text))),
        float(bool(re.search(SECRET_WORDS, before))), float(bool(re.search(ID_WORDS, before))),
        float(len(set(text))), share(" "), float(bool(re.search(ASSIGNED, before))),
    ]


def feature_columns(text: Column, before: Column) -> list[Column]:
    n = F.length(text)
    share = lambda p: F.length(F.regexp_replace(text, p, "")) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    distinct = F.size(F.array_distinct(F.split(text, "", -1)))
    return [
        n.cast("double"), share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"), share("[A-Za-z0-9]"),
        distinct / n,
        flag(text.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), flag(text.rlike(KNOWN_FORM)), flag(text.rlike(NUMBER_FORM)),
        flag(before.rlike(SECRET_WORDS)), flag(before.rlike(ID_WORDS)), distinct.cast("double"), share("[^ ]"), flag(before.rlike(ASSIGNED)),
    ]


def examples(seed: int = 3) -> list[tuple[list[float], int]]:
    """Labelled candidates (1 a secret, 2 an identifier, 0 neither): secrets and identity codes with and without context, and things that look alike."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(pick("bcdfglmnprst", 1) + pick("aeiou", 1) for _ in range(rng.randint(2, 6)))
    rows: list[tuple[str, str, int]] = []
    for _ in range(60):
        plain = " " + word() + " " + word() + " "
        secret = " " + rng.choice(["token", "password", "secret", "api_key", "pwd"]) + rng.choice([' = "', "=", ": ", ":'"])
        ident = " " + rng.choice(["SSN ", "passport: ", "IBAN ", "account number ", "tax id: "])
        rows += [
            (pick("0123456789abcdef", rng.randint(32, 64)), secret, 1),
            (pick("0123456789abcdef", rng.randint(12, 40)), secret, 1),
            (pick(low + up + dig, rng.randint(10, 40)) + "7", secret, 1),
            (pick(low + up + dig + "_-", rng.randint(24, 48)) + "Q4", plain, 1),
            ("AKIA" + pick(up + dig, 16), plain, 1),
            (pick(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), rng.randint(32, 64)), plain, 1),
            (f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}", ident, 2),
            (f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}", plain, 2),
            (pick(up, 2) + pick(dig, 2) + pick(dig, 18), ident, 2),
            (pick(up, 1) + pick(dig, 8), ident, 2),
            (word() + word(), plain, 0),
            (word() + "-" + word(), plain, 0),
            ((word() + word() + word())[:20].capitalize() + "xyz", plain, 0),
            (pick(dig, rng.randint(9, 16)), plain, 0),
            (f"20{pick(dig, 2)}-{pick('01', 1)}{pick(dig, 1)}-{pick('012', 1)}{pick(dig, 1)}", plain, 0),
            (word() + "/" + word() + "/" + word(), plain, 0),
            ("=" * rng.randint(9, 30), plain, 0),
            (word() + pick(dig, 2) + word(), plain, 0),
            (word() + "_" + word() + pick(dig, 1), plain, 0),
            (word() + word() + word(), secret.replace("=", "").replace(":", ""), 0),
            # values after words: short, with marks, quoted
            (pick(low + up, rng.randint(2, 6)) + pick(dig, rng.randint(1, 3)), secret, 1),
            (word() + pick(dig, rng.randint(1, 4)) + pick("!@#$%&*.", 1), secret, 1),
            (pick(low + up, rng.randint(3, 8)) + pick("!@#$%&*.?", rng.randint(1, 3)) + pick(low + up + dig, rng.randint(2, 12)), secret, 1),
            (pick(low + up, 4) + pick(" ,;", 1) + pick(low + up + dig, rng.randint(4, 9)) + pick(dig, 2), secret.rstrip("\"'") + '"', 1),
            # numbers and codes in groups
            (f"{pick(dig, 3)} {pick(dig, 2)} {pick(dig, 4)}", ident, 2),
            (pick(up, 2) + pick(dig, 2) + "".join(" " + pick(rng.choice([up, dig, dig, dig]), 4) for _ in range(rng.randint(3, 6))) + " " + pick(dig, 2), rng.choice([ident, plain]), 2),
            (pick(up, rng.randint(0, 2)) + pick(dig, rng.randint(6, 12)), ident, 2),
            ("-".join(pick(dig, rng.randint(2, 4)) for _ in range(3)), ident, 2),
            # keys on one line
            (pick(low + up + dig + "/+", rng.randint(600, 3000)), rng.choice([secret, plain]), 1),
            (pick("0123456789abcdef", rng.randint(128, 2048)), rng.choice([secret, plain]), 1),
            # and what isn't any of these
            (word(), rng.choice([secret, ident]), 0),
            (word(), rng.choice([" the password ", " a secret ", " access token ", " an account "]), 0),
            (word() + "-" + word(), rng.choice([" the password ", " a secret ", " access token ", " an account "]), 0),
            (word() + "()", " token = ", 0),
            (word() + " " + word() + " " + word() + " " + word(), secret.rstrip("\"'") + '"', 0),
            (pick(dig, rng.randint(1, 2)), secret, 0),
            (" ".join(pick(dig, rng.randint(1, 4)) for _ in range(rng.randint(2, 9))), plain, 0),
            (f"{pick(dig, 1)}.{pick(dig, rng.randint(1, 3))}", rng.choice([plain, " account ", secret]), 0),
            (f"{pick(dig, 2)}/{pick(dig, 2)}/{pick(dig, 4)}", plain, 0),
            (f"{pick(dig, 3)}-{pick(dig, 4)}", plain, 0),
            (pick("-=_/+", 1) * rng.randint(300, 3000), plain, 0),
            (pick(low + up, 1) * rng.randint(100, 3000), plain, 0),
            (pick(dig, rng.randint(20, 1000)), plain, 0),
            ("/".join(word() for _ in range(rng.randint(20, 200))), plain, 0),
            ("".join(word() for _ in range(rng.randint(10, 300))), plain, 0),
            (word().upper() + "_" + word().upper(), plain, 0),
            (word().upper() + word().upper(), plain, 0),
            (word().capitalize() + word().capitalize() + word().capitalize(), plain, 0),
            (word() + "-" + word() + "-" + word() + "-" + word(), plain, 0),
        ]
    rng.shuffle(rows)  # so that either half has all kinds
    return [(features_of(t, b), y) for t, b, y in rows]


def _best_split(rows, residual, index, least: int = 5):
    """The split of the rows that lowers the squared error of the residuals most."""
    total, n = sum(residual[i] for i in index), len(index)
    best = None
    for k in range(len(FEATURES)):
        order = sorted(index, key=lambda i: rows[i][k])
        left = 0.0
        for at in range(1, n):
            left += residual[order[at - 1]]
            a, b = rows[order[at - 1]][k], rows[order[at]][k]
            if a == b or at < least or n - at < least:
                continue
            gain = left * left / at + (total - left) ** 2 / (n - at) - total * total / n
            if best is None or gain > best[0] + 1e-12:
                best = (gain, k, (a + b) / 2)
    return best


def _tree(rows, residual, hessian, index, depth: int):
    split = _best_split(rows, residual, index) if depth else None
    if split is None or split[0] < 1e-9:
        return sum(residual[i] for i in index) / (sum(hessian[i] for i in index) + 1.0)
    _, k, bound = split
    low = [i for i in index if rows[i][k] <= bound]
    high = [i for i in index if rows[i][k] > bound]
    return k, bound, _tree(rows, residual, hessian, low, depth - 1), _tree(rows, residual, hessian, high, depth - 1)


def evaluate(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        k, bound, low, high = tree
        tree = low if row[k] <= bound else high
    return tree


def grown(rows: list[list[float]], y: list[int], rounds: int, depth: int = 3, rate: float = 0.5) -> list:
    """Trees by gradient boosting of the logistic loss, each with its rate."""
    score = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _tree(rows, [a - b for a, b in zip(y, p, strict=True)], [q * (1 - q) for q in p], range(len(rows)), depth)
        trees.append((rate, tree))
        score = [s + rate * evaluate(tree, r) for s, r in zip(score, rows, strict=True)]
    return trees


def summed(trees: list, row: list[float]) -> float:
    return sum(rate * evaluate(t, row) for rate, t in trees)


def least_score(seen: list[tuple[float, bool]], precision: float = 0.99) -> float:
    """The smallest score at which the precision holds, half-way to the next score below."""
    seen = sorted(seen, reverse=True)
    threshold, hits = 0.0, 0
    for n, (s, label) in enumerate(seen, 1):
        hits += label
        if n == len(seen) or seen[n][0] < s:
            if hits / n >= precision:
                threshold = (s + seen[n][0]) / 2 if n < len(seen) else s
    return threshold


@cache
def boosted(rounds: int = 25) -> tuple[list, float]:
    """The trees that select redactions, grown on every other example, and the threshold calibrated on the rest of them."""
    data = examples()
    own, rest = data[::2], data[1::2]
    trees = grown([r for r, _ in own], [int(y > 0) for _, y in own], rounds)
    return trees, least_score([(summed(trees, r), y > 0) for r, y in rest])


@cache
def kinds(rounds: int = 6) -> list:
    """Trees whose score is over 0 for an identifier and not for a secret, grown on the examples that are either."""
    own = [(r, y) for r, y in examples()[::2] if y]
    return grown([r for r, _ in own], [int(y == 2) for _, y in own], rounds)


@cache
def calibrated() -> dict[str, float]:
    """The threshold of each kind: that of the other half's examples that the trees take for this kind."""
    trees, rest = boosted()[0], examples()[1::2]
    is_id = [summed(kinds(), r) > 0 for r, _ in rest]
    return {kind: least_score([(summed(trees, r), y > 0) for (r, y), on in zip(rest, is_id, strict=True) if on == (kind == "id")]) for kind in ADDED}


#: A plain word: nine letters or more, none but the first upper-case, and not all of them hexadecimal digits; the ranges of its features.
PLAIN_WORD, NOT_HEX = "^[A-Za-z][a-z]{8,}$", "[g-z]"
_ANY = (-math.inf, math.inf)
PLAIN_RANGES = {
    "length": (9.0, math.inf), "digit_share": (0.0, 0.0), "upper_share": (0.0, 1 / 9), "lower_share": (8 / 9, 1.0), "mark_share": (0.0, 0.0), "hex": (0.0, 0.0),
    "known_form": (0.0, 0.0), "number_form": (0.0, 0.0), "after_secret_word": (0.0, 0.0), "after_id_word": (0.0, 0.0), "space_share": (0.0, 0.0), "assigned": (0.0, 0.0),
}


def most(tree, ranges: list[tuple[float, float]]) -> float:
    """The largest leaf of a tree that features in these ranges can reach."""
    if not isinstance(tree, tuple):
        return tree
    k, bound, low, high = tree
    low_end, high_end = ranges[k]
    return max([most(t, ranges) for t, on in ((low, low_end <= bound), (high, high_end > bound)) if on])


@cache
def plain_words_stay() -> bool:
    """Whether no plain word that follows no telling one can be selected: then the trees needn't be asked."""
    ranges = [PLAIN_RANGES.get(f, _ANY) for f in FEATURES]
    return sum(rate * most(t, ranges) for rate, t in boosted()[0]) < min(calibrated().values())


def _tree_column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    k, bound, low, high = tree
    return F.when(features[k] <= bound, _tree_column(low, features)).otherwise(_tree_column(high, features))


def score_column(values: Column, trees: list | None = None) -> Column:
    """Summed score of the trees (those that select redactions, if none are given) for an array of features."""
    features = [F.get(values, F.lit(k)) for k in range(len(FEATURES))]
    total = F.lit(0.0)
    for rate, tree in boosted()[0] if trees is None else trees:
        total = total + rate * _tree_column(tree, features)
    return total


def _free(proposed: Column, base: Column) -> Column:
    """The different candidates that no base span overlaps, in order; both lists are gone through once in either direction."""
    event = "struct<start:int,last:int,end:int,text:string,before:string,on:boolean>"
    as_event = lambda s, last, text, before: F.struct(s["start"].alias("start"), F.lit(last).alias("last"), s["end"].alias("end"), text.alias("text"), before.alias("before"))
    events = F.sort_array(F.concat(F.transform(base, lambda s: as_event(s, 0, F.lit(""), F.lit(""))), F.transform(proposed, lambda s: as_event(s, 1, s["text"], s["before"]))))
    kept = lambda s, on: F.struct(*[s[n].alias(n) for n in ("start", "last", "end", "text", "before")], on.alias("on"))

    def forward(state: Column, s: Column) -> Column:  # state: end of the base spans so far, and the last candidate
        is_base = s["last"] == 0
        on = (s["start"] >= state["covered"]) & ((s["start"] != state["start"]) | (s["end"] != state["end"]))
        after = F.struct(
            F.when(is_base, F.greatest(state["covered"], s["end"])).otherwise(state["covered"]).alias("covered"),
            F.when(is_base, state["start"]).otherwise(s["start"]).alias("start"), F.when(is_base, state["end"]).otherwise(s["end"]).alias("end"),
        )
        return _told(after, kept(s, F.when(is_base, F.lit(False)).otherwise(on)))

    def backward(state: Column, s: Column) -> Column:  # state: start of the base span that follows
        return _told(F.when(s["last"] == 0, s["start"]).otherwise(state), kept(s, s["on"] & (s["end"] <= state)))

    zero = F.struct(F.lit(0).alias("covered"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    there = gathered(events, zero, event, forward)["outs"]
    back = gathered(F.reverse(there), F.lit((1 << 31) - 1), event, backward)["outs"]
    return F.reverse(F.filter(back, lambda s: s["on"]))


def added_spans(text: Column, base: Column) -> Column:
    """Spans that the trees select among all candidates and that no base span overlaps; those that overlap are joined."""
    least = calibrated()
    some = []
    for names, needed in NEEDED.items():
        own = F.concat(*[candidates(text, GENERATORS[n]) for n in names])
        some.append(own if needed is None else F.when(_holds(text, needed), own).otherwise(F.array().cast(f"array<{CANDIDATE}>")))

    def scored(s: Column) -> Column:
        def both(values: Column) -> Column:
            ident = score_column(values, kinds()) > 0
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), score_column(values).alias("score"), ident.alias("ident"))

        return _let(F.array(*feature_columns(s["text"], s["before"])), both)

    def open_(s: Column) -> Column:
        """All candidates but those whose score is known to be too low."""
        told = s["before"].rlike(SECRET_WORDS) | s["before"].rlike(ID_WORDS) | s["before"].rlike(ASSIGNED)
        return ~s["text"].rlike(PLAIN_WORD) | ~s["text"].rlike(NOT_HEX) | told

    proposed = F.concat(*some)
    if plain_words_stay():
        proposed = F.filter(proposed, open_)

    high = lambda s: s["score"] >= F.when(s["ident"], F.lit(least["id"])).otherwise(F.lit(least["secret"]))
    chosen = F.filter(F.transform(_free(proposed, base), scored), high)
    group = "struct<start:int,end:int,score:double,ident:boolean>"
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0.0).alias("score"), F.lit(False).alias("ident"))

    def step(last: Column, s: Column) -> Column:
        ident = F.when(s["score"] > last["score"], s["ident"]).otherwise(last["ident"])
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.greatest(last["score"], s["score"]).alias("score"), ident.alias("ident"))
        meets = s["start"] < last["end"]
        return _told(F.when(meets, both).otherwise(s), F.when(~meets & (last["start"] >= 0), last))

    def ended(all_: Column) -> Column:
        whole = F.filter(all_["outs"], lambda s: s.isNotNull())
        return F.when(all_["state"]["start"] >= 0, F.concat(whole, F.array(all_["state"]))).otherwise(whole)

    joined = _let(gathered(chosen, zero, group, step), ended)

    def named(spans: Column) -> Column:
        def one(blocks: Column) -> Column:
            def span(s: Column) -> Column:
                kind = F.when(s["ident"], F.lit(ADDED[1])).otherwise(F.lit(ADDED[0]))
                number = F.when(s["ident"], F.lit(len(BASE) + 1)).otherwise(F.lit(len(BASE)))
                return F.struct(s["start"].alias("start"), number.alias("kind_no"), s["end"].alias("end"), kind.alias("kind"), piece(blocks, s["start"], s["end"] - s["start"]).alias("text"))

            return F.transform(spans, span)

        return F.when(F.size(spans) > 0, _let(blocks_of(text), one)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(joined, named)


def _joined(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def _with_spans(docs: DataFrame, base: str, spans: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(base, base_spans(text))
    return rows.withColumn(spans, F.sort_array(F.concat(base, added_spans(text, F.col(base)))))


def spans_of(docs: DataFrame) -> DataFrame:
    """``text`` of ``docs`` with ``pii_base`` and ``pii_spans``, arrays of spans of the whole text, and all columns of other names."""
    return _with_spans(docs.drop("pii_base", "pii_spans"), "pii_base", "pii_spans")


def found(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans and all spans as text."""
    rows = spans_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.size(F.filter("pii_base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span of ``text`` replaced by its kind in square brackets; ``n_chars`` follows."""
    base, spans = free_names(docs, 2)
    text = F.coalesce("text", F.lit(""))
    rows = _with_spans(docs, base, spans)

    def clean(blocks: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            # a span that begins inside the one before only lengthens it
            lead = piece(blocks, at, s["start"] - at)
            out = F.when(s["start"] < at, F.lit("")).otherwise(F.concat(lead, F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return _told(F.greatest(at, s["end"]), out)

        rest = lambda x: F.concat(F.array_join(x["outs"], ""), piece(blocks, x["state"], F.length(text) - x["state"]))
        return _let(gathered(F.col(spans), F.lit(0), "string", step), rest)

    out = rows.withColumn("text", F.when(F.size(spans) > 0, _let(blocks_of(text), clean)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

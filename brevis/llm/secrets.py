"""Secret scans: known shapes by pattern, and any other random-looking string by sliding-window entropy.

A candidate is a long run of letters, digits and `+/_-` with a digit in it. Its character class (hex digits, or mixed)
sets the limit. A window moves over it while the counts of its characters are kept up: one goes out, one comes in, and the
sum of c * log2 c changes by those two alone, so each step costs the same. The highest entropy of any window decides. An allow-list of well-known
harmless shapes suppresses findings, and so does overlap with a pattern's span. Positions are in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once, running

# The patterns of the base kinds, as given.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
HEX_LIMIT, MIXED_LIMIT = 3.0, 3.6
# Harmless shapes. UUIDs, dates and version names, plain numbers, hyphenated words, paths, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9_/+-]+$",
    r"^[A-Za-z]*+(?:[-_/+][A-Za-z]++)*+[-_/+]?[0-9]{1,4}$",
    r"(?i)example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh",
)


SPANS = "array<struct<a:int,z:int,i:int>>"


def located(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, number) of `found`, the leftmost non-overlapping matches of the pattern."""

    def place(between: Column) -> Column:
        # the ends: what lies before and in the matches, summed up
        sizes = F.transform(found, lambda v, i: F.length(F.get(between, i)) + F.length(v))
        ends = running(sizes, lambda x, y: x + y)
        return let(ends, lambda z: F.transform(found, lambda v, i: F.struct((F.get(z, i) - F.length(v)).alias("a"), F.get(z, i).alias("z"), i.alias("i"))))

    return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(let(F.split(text, pattern, -1), place))


def base_spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The spans of matches whose group has `least` characters or more."""

    def long_enough(spans: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.when(F.size(spans) == 0, spans).otherwise(let(values, lambda v: F.filter(spans, lambda x: F.length(F.get(v, x["i"])) >= least)))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: located(text, pattern, f))
    return let(spans, long_enough) if least else spans


#: Counts of up to 31 are kept in five bits each, twelve in a long.
BITS, LANES = 5, 12


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window (of up to 31) of a string of at least `window` characters of ALPHABET."""
    n_longs = -(-len(ALPHABET) // LANES)
    weight = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    more = F.array(*(F.lit(b - a) for a, b in zip(weight, weight[1:])))  # what one character more adds to a count's weight

    def slide(codes: Column) -> Column:
        fields = [f"c{k}" for k in range(n_longs)]

        def lane(code: Column) -> Column:
            return F.floor(code / LANES).cast("int")

        def unit(code: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("long"), (code % LANES) * BITS)

        def count(st: Column, code: Column) -> Column:
            held = F.get(F.array(*(st[f] for f in fields)), lane(code))
            return F.call_function("shiftright", held, (code % LANES) * BITS).bitwiseAND(F.lit(31)).cast("int")

        def changed(st: Column, code: Column, sign: int) -> list[Column]:
            return let(F.struct(lane(code).alias("k"), unit(code).alias("u")), lambda p: F.struct(*(F.when(p["k"] == j, st[f] + sign * p["u"]).otherwise(st[f]).alias(f) for j, f in enumerate(fields))))

        def into(st: Column, code: Column) -> Column:
            """One character comes in."""
            return let(changed(st, code, 1), lambda c: F.struct(*(c[f].alias(f) for f in fields), (st["sum"] + F.get(more, count(st, code))).alias("sum"), st["least"].alias("least")))

        def out(st: Column, code: Column) -> Column:
            return let(changed(st, code, -1), lambda c: F.struct(*(c[f].alias(f) for f in fields), (st["sum"] - F.get(more, count(st, code) - 1)).alias("sum"), st["least"].alias("least")))

        def seen(st: Column) -> Column:
            return F.struct(*(st[f].alias(f) for f in fields), st["sum"].alias("sum"), F.least(st["least"], st["sum"]).alias("least"))

        def step(st: Column, i: Column) -> Column:
            def move(old: Column, new: Column) -> Column:
                return F.when(old == new, st).otherwise(let(out(st, old), lambda a: let(into(a, new), seen)))

            return let(F.get(codes, i - window), lambda old: let(F.get(codes, i), lambda new: move(old, new)))

        none = F.struct(*(F.lit(0).cast("long").alias(f) for f in fields), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))
        head = F.aggregate(F.slice(codes, 1, window), none, into, seen)
        rest = F.when(F.size(codes) > window, F.sequence(F.lit(window), F.size(codes) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rest, head, step, lambda st: st["least"])

    codes = F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return F.log2(F.lit(float(window))) - let(codes, slide) / window


def random_strings(text: Column) -> Column:
    """Spans of candidates whose peak entropy reaches their class's limit and that no allowed shape covers."""

    def judge(value: Column) -> Column:
        fine = value.rlike(ALLOWED[0])
        for shape in ALLOWED[1:]:
            fine = fine | value.rlike(shape)
        hexed = value.rlike("^([0-9a-f]+|[0-9A-F]+)$")
        limit = F.when(hexed, F.lit(HEX_LIMIT)).otherwise(F.lit(MIXED_LIMIT))
        mixed = hexed | (value.rlike("[A-Za-z]") & value.rlike("[0-9].*[0-9]"))
        return F.when(fine | ~mixed, F.lit(False)).otherwise(peak_entropy(value) >= limit)

    def judged(found: Column) -> Column:
        return F.filter(located(text, CANDIDATE, found), lambda x: judge(F.get(found, x["i"])))

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda f: F.when(F.size(f) == 0, F.array().cast(SPANS)).otherwise(judged(f)))


def apart(spans: Column, known: Column) -> Column:
    """Those spans that share no character with any of the known ones (structs with a and z)."""

    def by_start(order: Column) -> Column:
        # the greatest end of all known spans that start before a span's end tells; they are found by halving
        ends = running(F.transform(order, lambda s: s["z"]), lambda x, y: F.greatest(x, y))
        halves = F.array(*(F.lit(1 << k) for k in reversed(range(27))))

        def free(e: Column, top: Column) -> Column:
            before = F.aggregate(halves, F.lit(0), lambda n, k: F.when((n + k <= F.size(order)) & (F.get(order, n + k - 1)["a"] < e["z"]), n + k).otherwise(n))
            return F.coalesce(F.get(top, before - 1) <= e["a"], F.lit(True))

        return let(ends, lambda top: F.filter(spans, lambda e: free(e, top)))

    return F.when((F.size(spans) == 0) | (F.size(known) == 0), spans).otherwise(let(F.sort_array(known), by_start))


def scan(text: Column) -> Column:
    """n_assign, n_access, n_hex, base (spans of the base kinds) and spans (all), as kind:start:end by start, then kind."""
    text_kinds = F.array(*map(F.lit, KINDS))

    def tag(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.lit(k).alias("k"), s["z"].alias("z")))

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(text_kinds, s["k"]), s["a"].cast("string"), s["z"].cast("string"))), ",")

    def all_of(b: Column) -> Column:
        base = F.concat(*(tag(b[k], i) for i, k in enumerate(KINDS[:3])))

        def more(known: Column) -> Column:
            extra = apart(b["entropy"], known)
            return F.struct(*(F.size(b[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]), shown(known).alias("base"), shown(F.concat(known, tag(extra, 3))).alias("spans"))

        return let(base, more)

    return let(F.struct(base_spans(text, ASSIGN, 2, 6).alias("assign"), base_spans(text, ACCESS).alias("access"), base_spans(text, HEX).alias("hex"), random_strings(text).alias("entropy")), all_of)


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The findings of every row; a null text counts as empty and has none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    got = once(rows, "s", scan(F.col("text")))
    return got.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", F.sha2("s.base", 256).alias("base_sha256"), "s.spans")

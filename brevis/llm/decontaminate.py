"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits in lower case. Every window of a document that is as long as an item, and those that
reach over an edge of the document, clipped to it, may hold the item: they do if their similarity (weighted Jaccard of
SHINGLE-word shingles, a shingle's weight being its occurrences) is SIMILARITY or more. Each window and each item gets a
64-bit SimHash. The fingerprints are cut into RADIUS + 1 blocks; two that differ in at most RADIUS bits agree in a block, so
an equi-join on (length, block) finds all of them. Their exact weighted similarity then decides.

Windows that can't reach SIMILARITY get no SimHash. Of c common shingles among n of the item and m of the window the
similarity is c / (n + m - c), so it takes c >= 2 * SIMILARITY * n / (1 + SIMILARITY) where m = n, and c >= SIMILARITY * n
where the window is clipped. c is at most the number of places in the window whose shingle is one of any item of that
length, so windows are laid at all starts from which that number is reached, whatever their alignment, and no other window
can hold an item. All of it is built-in expressions.

At a similarity of 0.8 the common shingles are 8/9 of each side, two such fingerprints differ in about 10 of 64 bits, with a
deviation of 3, and RADIUS lies over four deviations beyond.

Items are few and short, but their shingles are broadcast only if they are counted and few; else the join is shuffled. The
same holds for the keys of the documents with windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, once

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Rows of two or three numbers that are broadcast, at most.
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    """Runs of letters (with the marks that belong to them) and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(found: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order."""
    grams = F.transform(F.sequence(F.lit(0), F.size(found) - k), lambda i: F.xxhash64(*(F.get(found, i + j) for j in range(k))))
    return F.when(F.size(found) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Majority of each bit as an array of RADIUS + 1 blocks, numbers of two or three bits."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")))
    blocks = RADIUS + 1

    def cut_up(counts: Column) -> Column:
        def block(k: int) -> Column:
            ones = [F.when(2 * F.get(counts, F.lit(b)) > F.size(hashes), 1 << j).otherwise(0) for j, b in enumerate(range(64 * k // blocks, 64 * (k + 1) // blocks))]
            return sum(ones[1:], ones[0])

        return F.array(*map(block, range(blocks)))

    return let(bits, cut_up)


def apart(p: Column, q: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, v: n + v)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists."""

    def times(h: Column, x: Column) -> Column:
        return F.size(F.filter(h, lambda v: v == x))

    common = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return let(common, lambda n: n / (F.size(a) + F.size(b) - n))


def small(df: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are counted and few. `df` is read back from a store already."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def starts(places: Column, size: Column, least: Column) -> Column:
    """All starts s for which at least `least` of the places (ascending, distinct) lie in [s, s + size).

    With j the first place from s on, s is in (place j - 1, place j], and place j + least - 1 is below s + size.
    """

    def run(x: Column, j: Column) -> Column:
        low = F.greatest(F.get(places, j + least - 1) - size + 1, F.when(j > 0, F.get(places, j - 1) + 1))
        enough = (j + least <= F.size(places)) & (low <= x)
        return F.when(enough, F.sequence(low, x)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(places, run))


def shingle_count(n: Column, k: int) -> Column:
    """Shingles of n words; texts of fewer words than a shingle are one."""
    return F.greatest(n - k + 1, F.lit(1))


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start and n_words (in words of the document), bits and similarity, for each window that holds an item.

    These are all windows of the item's length. Of windows that reach over an edge the most similar one (the longest, the
    first of such) is given, and only where no whole window of the document holds the item. Items without words match
    nothing; items of fewer words than a shingle are matched whole, as one shingle. Null and empty texts hold nothing. Rows
    that share a doc_id and a text give their windows once.
    """
    args = shingle, least, doc_id, text, item_id, item_text
    return hashed_leaks(docs, benchmark, *args).drop("hash")


def hashed_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`leaks` with hash, the hash of the text, which tells rows of one doc_id apart."""
    items = once(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("t")), "w", tokens(F.coalesce("t", F.lit(""))))
    items = items.filter(F.size("w") > 0).withColumn("n", F.size("w"))
    sizes = sorted({min(shingle, r.n) for r in items.groupBy(F.least("n", F.lit(shingle)).alias("n")).count().collect()})
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, hash long, item_id long, start long, n_words long, bits int, similarity double")
    parts = [once(items.filter(F.least("n", F.lit(shingle)) == k), "h", shingles(F.col("w"), k)).select("item_id", "n", "h") for k in sizes]
    known = parts[0]
    for p in parts[1:]:
        known = known.union(p)
    known = cut(known.withColumn("fp", simhash(F.col("h"))))
    # the lengths of the items that hold a shingle, so that a place of a document gives one row however many items hold it
    lengths = cut(known.select(F.least("n", F.lit(shingle)).alias("k"), "n", F.explode("h").alias("h")).groupBy("k", "h").agg(F.collect_set("n").alias("ns")))
    near = small(lengths)

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))

    def sized(k: int):
        return lambda w: shingles(w, k)

    found = None
    for k in sizes:
        at = keyed.select("doc_id", "hash", F.posexplode(let(tokens(F.col("text")), sized(k))).alias("pos", "h"))
        hits = at.join(near.filter(F.col("k") == k).drop("k"), "h").select("doc_id", "hash", F.explode("ns").alias("n"), "pos")
        found = hits if found is None else found.union(hits)
    size = shingle_count(F.col("n"), shingle)
    whole, clipped = (F.ceil(x * size - F.lit(1e-9)).cast("int") for x in (2 * least / (1 + least), least))
    spots = found.groupBy("doc_id", "hash", "n").agg(F.array_sort(F.collect_set("pos")).alias("p")).filter(F.size("p") >= clipped)
    spots = spots.select("doc_id", "hash", F.struct("n", starts(F.col("p"), size, whole).alias("whole"), starts(F.col("p"), size, clipped).alias("clipped")).alias("s"))
    spots = cut(spots.filter(F.size("s.clipped") > 0).groupBy("doc_id", "hash").agg(F.collect_list("s").alias("spots")))
    held = spots.withColumnsRenamed({"doc_id": "d", "hash": "x"})
    numbers = F.aggregate("spots", F.lit(0), lambda a, s: a + 3 + F.size(s["whole"]) + F.size(s["clipped"]))
    if (spots.agg(F.sum(numbers)).first()[0] or 0) <= BROADCAST_ROWS:
        held = F.broadcast(held)
    held = keyed.join(held, keyed.doc_id.eqNullSafe(F.col("d")) & (keyed.hash == F.col("x"))).dropDuplicates(["doc_id", "hash"])

    def laid_out(w: Column) -> Column:
        m = F.size(w)

        def of_length(s: Column, k: int, h: Column) -> Column:
            n = s["n"]
            inside = F.filter(s["whole"], lambda a: (a >= 0) & (a + n <= m))
            over = F.filter(s["clipped"], lambda a: (a < 0) | (a + n > m))
            # over both edges a window is the whole document, whatever its start

            def window(a: Column) -> Column:
                first = F.greatest(a, F.lit(0))
                size = F.least(a + n, m) - first
                # no slice: it would copy all of the text's shingles for each window
                return F.struct(first.alias("start"), size.alias("len"), n.alias("n"), F.transform(F.sequence(first, first + size - k), lambda i: F.get(h, i)).alias("h"))

            return F.transform(F.array_distinct(F.transform(F.concat(inside, over), lambda a: F.when((m < n) & (a >= m - n) & (a <= 0), 0).otherwise(a))), window)

        def of_size(k: int) -> Column:
            own = F.filter("spots", lambda s: F.least(s["n"], F.lit(shingle)) == k)
            return let(shingles(w, k), lambda h: F.flatten(F.transform(own, lambda s: of_length(s, k, h))))

        return F.concat(*map(of_size, sizes))

    laid = held.select("doc_id", "hash", F.explode(let(tokens(F.col("text")), laid_out)).alias("v")).select("doc_id", "hash", "v.*")
    laid = once(laid, "fp", simhash(F.col("h")))
    blocks = lambda df, *c: df.select(*c, F.posexplode("fp").alias("b", "v"))
    theirs = blocks(known.withColumnsRenamed({"h": "ih", "fp": "ifp"}).withColumn("fp", F.col("ifp")), "item_id", "n", "ih", "ifp")
    ours = blocks(laid.withColumn("fp0", F.col("fp")), "doc_id", "hash", "start", "len", "n", "h", "fp0")
    few = known.agg(F.sum(F.size("h"))).first()[0] <= BROADCAST_ROWS
    met = ours.join(F.broadcast(theirs) if few else theirs, ["n", "b", "v"])
    # a pair that agrees in several blocks is taken at the first of them
    same = F.array_position(F.zip_with("fp0", "ifp", lambda a, b: a == b), F.lit(True)) - 1
    met = met.filter((F.col("b") == same) & (apart(F.col("fp0"), F.col("ifp")) <= RADIUS))
    rated = met.select("doc_id", "hash", "item_id", "n", F.struct(similarity(F.col("h"), F.col("ih")).alias("similarity"), F.col("len").cast("long").alias("n_words"), F.col("start").cast("long").alias("start"), apart(F.col("fp0"), F.col("ifp")).alias("bits")).alias("w"))
    rated = rated.filter(F.col("w.similarity") >= least).groupBy("doc_id", "hash", "item_id", "n").agg(F.collect_list("w").alias("all"))
    full = F.filter("all", lambda w: w["n_words"] == F.col("n"))
    best = F.aggregate("all", F.get("all", F.lit(0)), lambda a, w: F.when((w["similarity"] > a["similarity"]) | (w["similarity"] == a["similarity"]) & ((w["n_words"] > a["n_words"]) | (w["n_words"] == a["n_words"]) & (w["start"] < a["start"])), w).otherwise(a))
    given = rated.select("doc_id", "hash", "item_id", F.explode(F.when(F.size(full) > 0, full).otherwise(F.array(best))).alias("w"))
    return given.select("doc_id", "hash", "item_id", "w.start", "w.n_words", "w.bits", "w.similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no benchmark item is found. A row goes for its own text alone: others of its doc_id, or without one, stay."""
    found = small(cut(hashed_leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked"), F.col("hash").alias("_hash")).distinct()))
    own = F.xxhash64(F.coalesce(docs.text.cast("string"), F.lit("")))
    return docs.join(found, docs.doc_id.cast("long").eqNullSafe(F.col("_leaked")) & (own == F.col("_hash")), "left_anti")

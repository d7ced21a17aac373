"""Removal of runs of lines that occur earlier in the corpus, by winnowing with a window of one.

Winnowing takes the least hash of each window of w neighbouring runs of k units; repeats of w + k - 1 units or more are
guaranteed to share a fingerprint. Here a run is a shortest one of LEAST_WORDS words and w is 1, so every run is its window's
minimum and the guarantee begins at LEAST_WORDS itself. Wider windows were tried: lines between two minima then stay where
the minima have their first positions in other texts, so results weren't whole. Positions are joined by these fingerprints,
and matches extend both ways as the neighbouring runs, taken forward and backward from each line, match too.

A text is cut into lines: at line ends, and within long paragraphs after a sentence's end. Each line is a 64-bit hash. From
every line the shortest run of LEAST_WORDS words forward and the shortest one backward is a key. Which lines such a run takes
depends on their words alone, so equal runs of LEAST_WORDS words or more hold equal keys, and these cover all their lines.
Each key has its own first position in the order of (doc_id, text hash, position); all its later occurrences go, so exactly
the lines go that lie in a run of LEAST_WORDS words that occurs earlier. The earlier copy stays.

Keys are matched with their first position alone, so a line that a third of all rows hold costs one row for each occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, drop_dir, fresh_dir, let, once, stored

LEAST_WORDS = 8
#: Of the former rule (window minima, extended from the first position alone); the tests' oracle of that rule reads them.
WINDOW, REACH = 3, 3
#: Scripts written without blanks, as a character class body, and the characters that always count as a word.
UNSPACED, LONG_WORD = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}", 20
#: A line with the white space that follows it. It ends where white space that holds a line end or follows a sentence's end
#: meets a word. Nothing in it can backtrack, so it takes one pass over any text.
LINE = rf"(?s)(?=.)[^.!?\n]*+(?:[.!?\n](?![{SPACE}]*+(?<=[{SPACE}])[^{SPACE}])[^.!?\n]*+)*+(?:[.!?\n][{SPACE}]*+)?"


def lines(text: Column) -> Column:
    """The lines of a text with the white space that follows them; together they are the text."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def odd(text: Column) -> Column:
    """Whether a text has white space other than single blanks and line ends, or scripts without blanks."""
    # the second test only rules out quickly what the third would reject
    found = (F.octet_length(text) > F.char_length(text)) & text.rlike(r"[\u00A0\u0E00-\x{10FFFF}]") & text.rlike(rf"[\p{{Z}}{UNSPACED}&&[^ ]]")
    for mark in ("  ", "\t", "\x0b", "\x0c", "\r"):
        found = found | F.contains(text, F.lit(mark))
    return found


def n_words(line: Column, by_class: Column) -> Column:
    """Words of a trimmed line, runs of anything but white space and Unicode's blanks. Scripts without blanks count two characters
    as a word, and LONG_WORD characters count as one at least, so that no text is without words for its want of blanks.

    by_class: whether the text is odd. In others single blanks part the words, so it is enough to count them.
    """
    blanks = 1 + F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    classed = F.regexp_count(line, F.lit(rf"[{UNSPACED}]{{1,2}}|[^{SPACE}\p{{Z}}{UNSPACED}]+"))
    return F.when(line == "", 0).otherwise(F.greatest(F.when(by_class, classed).otherwise(blanks), F.floor(F.char_length(line) / LONG_WORD).cast("int"), F.lit(1)))


def runs(n: Column, least_words: int) -> Column:
    """The shortest runs of `least_words` words from each line forward and backward, as first position * SPAN + lines - 1.

    n: words of each line. Only a text's first line can have none, so a run takes at most least_words + 1 lines.
    """
    span = least_words + 1

    def extent(x: Column, i: Column, way: int) -> Column:
        """Lines that a run takes from line i (of x words, too few) on, null where the text has too few words that way."""
        out, words = F.when(F.lit(False), 0), x
        for k in range(1, span):
            place = i + way * k
            words = words + (F.get(n, place) if way > 0 else F.when(place >= 0, F.get(n, place)))
            out = out.when(words >= least_words, k + 1)
        return out

    def forward(x: Column, i: Column) -> Column:
        return F.when(x >= least_words, i * span).otherwise(i * span + extent(x, i, 1) - 1)

    def backward(x: Column, i: Column) -> Column:
        return F.when(x < least_words, let(extent(x, i, -1), lambda e: (i - e + 1) * span + e - 1))

    # the distinct ones that aren't null
    return F.array_except(F.concat(F.transform(n, forward), F.transform(n, backward)), F.array(F.lit(None).cast("int")))


def keyed(text: Column, least_words: int) -> Column:
    """at, the runs of a text, and h, the hashes of their lines: two arrays, as one of structs takes three times the room."""
    span = least_words + 1

    def key(h: Column):
        def of(r: Column) -> Column:
            def lines_of(first: Column) -> Column:
                rest = (F.when(F.lit(k) <= r % span, F.get(h, first + k)) for k in range(1, span))
                return F.when(r % span == 0, F.xxhash64(F.get(h, first))).otherwise(F.xxhash64(F.get(h, first), *rest))

            return let(F.floor(r / span).cast("int"), lines_of)

        return of

    def of(units: Column, by_class: Column) -> Column:
        hashed, n = F.transform(units, lambda x: F.xxhash64(x)), F.transform(units, lambda x: n_words(x, by_class))
        return let(let(n, lambda w: runs(w, least_words)), lambda at: F.struct(at.alias("at"), let(hashed, lambda h: F.transform(at, key(h))).alias("h")))

    trimmed = F.transform(lines(text), lambda x: F.btrim(x, F.lit(SPACE_CHARS)))
    return let(odd(text), lambda o: let(trimmed, lambda u: of(u, o)))


def removed_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """k_id, k_text and runs: for each document with repeated lines, its runs (as in `runs`) that occur earlier.

    rows: k_id (a long, null as the least), k_text (a hash of the text) and text. Only hashes of runs are shuffled, once for
    each document with a word; texts are cut into lines here alone. What repeated keys are joined with is read back from a
    store, so both sides are dealt for the join itself and adaptive execution may split the partition of a key that a third
    of all rows hold.
    """
    spark = rows.sparkSession
    top = fresh_dir(spark, "line-dedup")
    some = rows.filter(F.btrim("text", F.lit(SPACE_CHARS)) != "")
    found = stored(once(some, "r", keyed(F.col("text"), least_words)).select("k_id", "k_text", "r.*"), f"{top}/runs")
    each = found.select("k_id", "k_text", F.explode(F.arrays_zip("at", "h")).alias("r")).select("k_id", "k_text", "r.*")
    often = stored(each.groupBy("h").agg(F.count("*").alias("n"), F.min("k_id").alias("m")).filter("n > 1").select("h", "m"), f"{top}/repeated")
    late = F.col("k_id") > F.col("m")
    again = stored(each.join(often, "h").select(F.when(~late, F.col("h")).alias("h"), "k_id", "k_text", "at"), f"{top}/again")
    # of runs with equal keys, `at` sorts as the first positions do; only those of the least k_id need more than it to be ordered
    even = again.filter("h is not null")
    first = stored(even.groupBy("h").agg(F.min(F.struct("k_text", "at")).alias("o"), F.count("*").alias("n")).filter("n > 1").select("h", "o"), f"{top}/first")
    later = even.join(first, "h").filter(F.struct("k_text", "at") > F.col("o")).select("k_id", "k_text", "at")
    whole = again.filter("h is null").select("k_id", "k_text", "at").union(later).groupBy("k_id", "k_text").agg(F.collect_set("at").alias("runs"))
    out = stored(whole, fresh_dir(spark, "removed-runs"))
    drop_dir(spark, top)
    return out


def rid(text: Column, found: Column, least_words: int) -> Column:
    """The text without those runs of lines, and the number of lines that went."""
    span = least_words + 1

    def drop(units: Column) -> Column:
        first = lambda r: F.floor(r / span).cast("int")
        gone = F.array_distinct(F.flatten(F.transform(found, lambda r: F.sequence(first(r), first(r) + r % span))))
        left = lambda g: F.array_except(F.sequence(F.lit(0), F.size(units) - 1), g)
        return let(gone, lambda g: F.struct(F.array_join(F.transform(left(g), lambda i: F.get(units, i)), "").alias("text"), F.size(g).alias("n_removed")))

    whole = F.struct(text.alias("text"), F.lit(0).alias("n_removed"))
    return F.when(found.isNull(), whole).otherwise(let(lines(text), drop))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Each row as `doc`, and `clean`: its text without repeated runs, and n_removed, the lines that went.

    A null text stays null and an empty one empty. A null doc_id comes before all others. Rows that share a doc_id and a
    text are one document given twice: neither is later than the other. Lines that are equal within one document count
    as earlier and later too.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k_id"), F.xxhash64("text").alias("k_text")]
    rows = docs.select(F.struct("*").alias("doc"), *key, F.col("text").cast("string").alias("text"))
    found = removed_runs(rows.select("k_id", "k_text", "text"), least_words)
    both = rows.join(found, ["k_id", "k_text"], "left")
    return once(both, "clean", rid(F.col("text"), F.col("runs"), least_words)).select("doc", "clean")


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, the cleaned text, and n_removed for every row."""
    return without_repeats(docs).select(F.col("doc.doc_id").alias("doc_id"), F.col("clean.text").alias("text"), F.col("clean.n_removed").cast("long").alias("n_removed"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows with cleaned texts, in their own columns; n_chars follows the text where there is such a column."""
    new = {"text": F.col("clean.text"), "n_chars": F.length("clean.text").cast("long")}
    return without_repeats(docs).select(*((new.get(c) if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns))

"""Toxicity of texts after noisy-channel deobfuscation.

Suspicious strings (leetspeak, letters set apart, letters repeated) are read as a lattice: each sign stands for one of a few
letters or for nothing, and a run of one letter for one or two. Viterbi decoding under a character trigram model, counted
over the words of all documents, finds the likeliest letters. Plain words and restored words are then looked up in a
lexicon of weights learned from labelled documents; the score joins their evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# The letters that a sign may stand for. A sign that isn't listed separates.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
END = len(LETTERS)
SIZE = END + 1
#: Labelled documents from which the lexicon is learned, at most; those with the least hashed ids.
TRAIN_ROWS = 40_000
#: The least documents of a lexicon entry and its least rate of toxic ones.
LEAST_DOCS, LEAST_RATE = 3, 0.6
#: Least log-likelihood ratio statistic of an entry. Chosen among 12, 15, 18 and 24 for the best F1 of two folds of the labelled
#: rows that aren't held out (crc32 of the id mod 3 is 0 or 2), each scored with the lexicon of the other, on sf0.1.
EVIDENCE = 15.0

#: Letters of a word's beginning that stand for its stem, written with an asterisk.
STEMS = (4, 5)
#: Signs that are read together; of longer strings overlapping pieces are, so any word of up to LONGEST / 2 signs lies whole in one.
LONGEST = 80
WORDS = re.compile(r"[^\W\d_]+")
APART = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){3,}(?!\w)")
# Whole runs that hold a mixture of letters and signs, or a letter three times. They are tried at their beginnings alone, and
# only in texts that hold such a place at all, so the time is linear in the text.
RUN, MIXED = "a-z0-9@$!|+€£(*#", r"[a-z][0-9@$!|+€£(*#]+[a-z]|[a-z][@$!|+€£0-9]|[0-9@$!|+€£][a-z]"
LEET = re.compile(rf"(?<![{RUN}])(?=[{RUN}]*?(?:{MIXED}))[{RUN}]+")
REPEAT = re.compile(r"(?<![a-z])(?=[a-z]*?([a-z])\1\1)[a-z]+")
JOINED = re.compile(r"(?<!\w)[a-z]+(?:[.\-_*][a-z]+)+(?!\w)")
#: Each pattern with one that tells quickly whether a text can hold it.
SUSPICIOUS = ((APART, re.compile(r"(?<!\w)\w[ .\-_*]\w[ .\-_*]")), (LEET, re.compile(MIXED)), (REPEAT, re.compile(r"([a-z])\1\1")), (JOINED, re.compile(r"[a-z][.\-_*][a-z]")))


def trigram_model(docs: DataFrame) -> np.ndarray:
    """-log p(letter | two before), from the words of all whole texts; only the sums of 27^3 counts leave the executors."""

    table = bytearray([END] * 256)
    for i, c in enumerate(LETTERS.encode()):
        table[c] = i

    def count(batches):
        sums = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    codes = np.frombuffer(bytes([END, END]) + text.lower().encode().translate(bytes(table)) + bytes([END]), np.uint8).astype(np.int32)
                    sums += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE**3)), pa.array(sums)], ["gram", "n"])

    got = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[got["gram"].to_numpy()] = got["n"].to_numpy()
    cube = counts.reshape(SIZE, SIZE, SIZE)
    pair, one = cube.sum(0) + 0.01, cube.sum((0, 1)) + 1.0
    back = 0.9 * pair / pair.sum(1, keepdims=True) + 0.1 * one / one.sum()
    return -np.log((cube + 5 * back[None]) / (cube.sum(2, keepdims=True) + 5))


def lattice(noisy: str) -> list[list[tuple[str, float]]]:
    """For each run of equal signs the strings it may stand for, with their channel costs."""
    out = []
    for m in re.finditer(r"(.)\1*", noisy, re.DOTALL):
        sign, n = m[1], len(m[0])
        if sign in LETTERS:
            out.append([(sign, 0.2 * (n > 1)), (sign * 2, 0.2 * (n > 2))] if n > 1 else [(sign, 0.0)])
        elif sign in SIGNS:
            one = [(c, 0.5) for c in SIGNS[sign]]
            out.append(one + [(c * 2, 1.0) for c in SIGNS[sign]] * (n > 1) + [("", 4.0)])
        else:
            out.append([("", 0.0)])
    return out


def decode(noisy: str, costs: np.ndarray, best: int = 3) -> list[str]:
    """The `best` likeliest readings of a noisy string, likeliest first: a Viterbi search that keeps a few paths for each state."""
    paths = {(END, END): [(0.0, "")]}
    for column in lattice(noisy):
        after: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), held in paths.items():
            for letters, channel in column:
                p, q, cost = a, b, channel
                for c in letters:
                    k = ord(c) - 97
                    cost, p, q = cost + costs[p, q, k], q, k
                after.setdefault((p, q), []).extend((c0 + cost, s + letters) for c0, s in held)
        paths = {k: sorted(set(v))[:best] for k, v in after.items()}
    ends = sorted((c + costs[a, b, END], s) for (a, b), v in paths.items() for c, s in v)
    return list(dict.fromkeys(s for _, s in ends))[:best]


class Reader:
    """The plain and the restored words of texts; readings of strings are kept in bounded memory."""

    def __init__(self, costs: np.ndarray, keep: int = 50_000, longest: int = LONGEST):
        self.costs, self.keep, self.longest, self.known = costs, keep, longest, {}
        self.lexicon, self.dull = None, set()  # plain words without an entry in that lexicon, bounded as well

    def readings(self, noisy: str) -> list[str]:
        if len(noisy) > self.longest:
            step = self.longest // 2
            parts = dict.fromkeys(noisy[i : i + self.longest] for i in range(0, len(noisy) - step, step))
            return [s for p in parts for s in self.readings(p)]
        if (got := self.known.get(noisy)) is None:
            if len(self.known) > self.keep:
                self.known.clear()
            got = self.known[noisy] = decode(noisy, self.costs)
        return got

    def entries(self, plain: set[str], lexicon: dict[str, float]) -> set[str]:
        """The entries of a lexicon among plain words and their stems."""
        if lexicon is not self.lexicon or len(self.dull) > 4 * self.keep:
            self.lexicon, self.dull = lexicon, set()
        out: set[str] = set()
        for w in plain - self.dull:
            hits = [x for x in (w, *(f"{w[:k]}*" for k in STEMS if len(w) > k)) if x in lexicon]
            if hits:
                out.update(hits)
            else:
                self.dull.add(w)
        return out

    def __call__(self, text: str | None, lexicon: dict[str, float] | None = None) -> set[str]:
        """Words of a text, the restored ones among its suspicious strings, and the stems of both; with a lexicon, only what it holds."""
        low = (text or "").lower()
        plain = set(WORDS.findall(low))
        if lexicon is None:
            found = plain | {f"{w[:k]}*" for w in plain for k in STEMS if len(w) > k}
        else:
            found = self.entries(plain, lexicon)
        for pattern, quick in SUSPICIOUS:
            for m in pattern.finditer(low) if quick.search(low) else ():
                for s in self.readings(m[0].strip("!.,?*#|")):
                    for w in (s, *(f"{s[:k]}*" for k in STEMS if len(s) > k)):
                        if lexicon is None or w in lexicon:
                            found.add(w)
        return found


def train_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and toxic of at most `most` labelled rows that aren't held out, those with the least hashed ids."""
    ids = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def learn(rows: DataFrame, costs: np.ndarray) -> tuple[dict[str, float], float]:
    """(weight of each lexicon entry, log odds without any): weights are log ratios of document rates, and equal texts count once."""

    def count(batches):
        read = Reader(costs)
        for b in batches:
            got: Counter = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {"", *read(text)}:
                    got[w, toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got]), pa.array([t for _, t in got], pa.int64()), pa.array(list(got.values()), pa.int64())], ["w", "toxic", "n"])

    plain = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").cast("long").alias("toxic")).select("text", "toxic")
    sums = plain.mapInArrow(count, "w string, toxic long, n long").groupBy("w").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n"))
    sums = cut(sums.filter((F.col("w") == "") | (F.col("t") >= LEAST_DOCS)))
    total = sums.filter("w = ''").first()
    if total is None or not total.t or total.t == total.n:
        return {}, -2.0 if total is None or not total.t else 2.0
    rate = (F.col("t") + 0.5) / (F.col("n") + 1)
    t, n = total.t, total.n - total.t
    gain = lambda k, of, base: F.when(k > 0, 2 * k * F.log(k / of / base)).otherwise(0.0)
    evidence = gain(F.col("t"), F.col("n"), t / total.n) + gain(F.col("n") - F.col("t"), F.col("n"), n / total.n)
    sure = (F.col("w") != "") & (F.col("t") >= LEAST_DOCS) & (rate >= LEAST_RATE) & (evidence >= EVIDENCE)
    # as many as the bounded sample of labelled rows gives
    top = sums.filter(sure).collect()
    weights = {r.w: math.log((r.t + 0.5) / (t + 1)) - math.log((r.n - r.t + 0.5) / (n + 1)) for r in top}
    return weights, math.log(0.02)


def toxicity(docs: DataFrame, labels: DataFrame, train: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_terms for every row.

    A score is the logistic of a low base plus the weights of the distinct entries found; null, empty and unsuspicious
    texts get the base. A null doc_id is not held out. Labels of held-out rows are never read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    costs = trigram_model(own)
    lexicon, base = learn(train_rows(own, labels, train), costs)

    def score(batches):
        read = Reader(costs)
        for b in batches:
            hits = [read(t, lexicon) for t in b.column(1).to_pylist()]
            logits = [base + sum(lexicon[w] for w in sorted(h)) for h in hits]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in logits]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(list(map(len, hits)), pa.int32())], ["doc_id", "score", "n_terms"])

    got = own.mapInArrow(score, "doc_id long, score double, n_terms int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_terms")

import random
import re
from collections import Counter

from brevis.llm import decontaminate as D
from tests.conftest import SF

from .fixtures import empty_documents, odd_documents


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def brute(docs, items, least=D.SIMILARITY):
    out = set()
    for i, t in docs:
        w = words(t)
        for q, it in items:
            v = words(it)
            if not v:
                continue
            k = min(5, len(v))
            grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            want = grams(v)
            for s in range(len(w) - len(v) + 1):
                got = grams(w[s : s + len(v)]) if set(v) & set(w[s : s + 5 * k]) else Counter()
                low, high = sum((got & want).values()), sum((got | want).values())
                if low / high >= least:
                    out.add((i, q, s, len(v)))
    return out


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(25)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(5)
    own = items.collect()
    w = own[0].text.split()
    planted = [(1001, "He said: " + own[0].text.upper() + " and left"), (1002, "x y z " + " ".join(w[1:]) + " tail end"), (1003, " ".join(w[: len(w) // 2])), (None, own[1].text), (1004, own[2].text * 2)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string")).cache()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in own])
    got = D.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_words) for r in got} == want and len(got) == len(want)
    assert {1001, None, 1004} <= {r.doc_id for r in got} and 1003 not in {r.doc_id for r in got}
    assert {r.doc_id for r in D.keep_clean(docs, items).collect()}.isdisjoint({x[0] for x in want})


def test_odd_rows(spark):
    docs, items = odd_documents(spark), spark.createDataFrame([(1, "Nobody knows"), (2, None), (3, ""), (4, "number of this one it is a text of")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    assert got == {(None, 1), (None, 4)}
    assert D.keep_clean(docs, items).columns == docs.columns and D.keep_clean(docs, items).count() == docs.count() - 1
    assert D.leaks(empty_documents(spark), items).collect() == [] and D.leaks(docs, items.limit(0)).collect() == []


def test_clean_rows_of_a_leaked_id_stay(spark):
    item = " ".join(f"asked{i}" for i in range(30))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "So: " + item), (None, "Clean text without an id."), (None, None), (7, item + " end"), (7, "Clean text of the same id."), (8, "Clean.")]
    got = {(r.doc_id, r.text) for r in D.keep_clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {rows[1], rows[2], rows[4], rows[5]}


def test_items_clipped_at_an_edge(spark):
    w = [f"asked{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    cut = {1: w[1:], 2: w[:-2], 3: w[2:-2], 4: w[2:] + ["then", "more"] * 30, 5: ["more", "first"] * 30 + w[:-3], 6: w[20:], 7: w[8:] + ["then"] * 60, 8: w, 9: w[5:] + ["then", "more"] * 30, 10: ["more", "first"] * 30 + w[:-6]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in cut.items()], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_words, round(r.similarity, 9)) for r in D.leaks(docs, items).collect())
    # of 36 shingles: whole windows that begin or end in the item, else the words that are left, from the edge
    whole = [(4, 0, 40, 34 / 38), (4, 1, 40, 33 / 39), (4, 2, 40, 32 / 40), (5, 56, 40, 32 / 40), (5, 57, 40, 33 / 39), (8, 0, 40, 1)]
    clipped = [(1, 0, 39, 35 / 36), (2, 0, 38, 34 / 36), (3, 0, 36, 32 / 36), (9, 0, 35, 31 / 36), (10, 60, 34, 30 / 36)]
    assert got == sorted((*x, round(y, 9)) for *x, y in whole + clipped)
    assert {r.doc_id for r in D.keep_clean(docs, items).collect()} == {6, 7}


def test_altered_passages_are_all_found(spark):
    """Passages with trimmed ends, changed and inserted words, inside other text and alone: all windows and all links."""
    rng = random.Random(11)
    own = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    rows = []
    for k in range(160):
        p = words(rng.choice(own)[1])
        a, b = rng.randrange(3), rng.randrange(3)
        p = p[a : len(p) - b]
        for _ in range(rng.randrange(2)):
            p[rng.choice([0, 1, -1, rng.randrange(len(p))])] = f"new{k}"
        if rng.random() < 0.3:
            p.insert(rng.randrange(len(p)), f"more{k}")
        lead, tail = ([f"x{rng.randrange(900)}" for _ in range(rng.choice([0, 3, 50]))] for _ in "ab")
        rows.append((k, " ".join(lead + p + tail)))
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string")).collect()
    want = brute(rows, own)
    size = {i: len(words(t)) for i, t in own}
    assert {(r.doc_id, r.item_id, r.start, r.n_words) for r in got if r.n_words == size[r.item_id]} == want and len(want) > 200
    clipped = {(r.doc_id, r.item_id) for r in got if r.n_words < size[r.item_id]}
    assert clipped.isdisjoint({x[:2] for x in want}) and clipped


def test_starts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    cases = [(sorted(rng.sample(range(30), rng.randrange(12))), rng.randrange(1, 9), rng.randrange(1, 6)) for _ in range(60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<int>, size int, least int")
    got = {r.i: r.s for r in df.select("i", D.starts(F.col("p"), F.col("size"), F.col("least")).alias("s")).collect()}
    for i, (p, size, least) in enumerate(cases):
        assert got[i] == [s for s in range(-20, 40) if sum(s <= x < s + size for x in p) >= least]

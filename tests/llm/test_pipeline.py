import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from brevis.llm import rules
from brevis.llm.queries import vocabulary
from tests.conftest import SF

from . import test_decontaminate, test_linededup, test_simhash
from .test_tokens import crc, ids_of


def planted(spark, folder):
    """Documents of the smallest table, and of each thing that a stage removes some more; rows without an id and with a shared one."""
    rng = random.Random(12)
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    words = [w for _, t, lang, *_ in docs if lang == "en" for w in (t or "").split() if w.isalpha() and w.islower()]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    at = 100_000
    for n in (60, 90, 200):
        base = prose(n).split()
        for k in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"other{k}"
            docs.append((at, " ".join(copy), "en", "near", 1))
            at += 1
    for i, t in items:
        docs += [(at, prose(40) + " " + t + " " + prose(40), "en", "leak", 1), (None, prose(30) + " " + t, "en", "leak", 1), (5, prose(35) + " " + t, "en", "leak", 1)]
        at += 1
    docs += [(None, prose(60), "en", "clean", 1), (5, prose(61), "en", "clean", 1), (at, None, None, None, None), (at + 1, "", "en", "s", 0), (at + 2, "x! " * 50, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def near(rows):
    """Of each component of rows by all pairs, the least."""
    sets = [test_simhash.shingle_set(t) for _, t in rows]
    fps = [test_simhash.brute_fp(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or rows[i][1].split() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, test_linededup.h64(rows[i][1]))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted((rows[min(g, key=order)] for g in groups.values()), key=str)


def test_stages_match_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = docs
        after = stage(spark, docs, folder)
        after.write.parquet(f"{folder}/{len(seen)}")
        docs = spark.read.parquet(f"{folder}/{len(seen)}")
        seen[name] = before, docs
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality rules"]
    kept = [(r["doc"].doc_id, r["doc"].text) for r in rules.judged(rules.measured(before).cache()).filter("rules.kept").collect()]
    assert texts(after) == sorted(kept, key=str) and 0 < after.count() < before.count()
    before, after = seen["line dedup"]
    assert texts(after) == sorted(((i, t) for i, t, _ in test_linededup.exact(texts(before))), key=str)
    before, after = seen["near dedup"]
    assert texts(after) == near(texts(before)) and before.count() - after.count() >= 9
    before, after = seen["decontamination"]
    found = test_decontaminate.brute(list(enumerate(t for _, t in texts(before))), items)
    rows = texts(before)
    assert texts(after) == [r for k, r in enumerate(rows) if k not in {i for i, *_ in found}] and found
    assert after.filter("source = 'clean'").count() == 2
    before, after = seen["packing"]
    tokenizer = Tokenizer.from_file(vocabulary())
    want = sorted(len(ids_of(tokenizer, t, 2)) for _, t in texts(before))
    pieces = after.collect()
    assert sum(r.length for r in pieces) == sum(want) and {r.doc_tokens for r in pieces} == set(want)
    assert np.all([r.ids_crc32 == crc(ids_of(tokenizer, t, 2)) for _, t in texts(before) for r in pieces if r.doc_id == _ and r.doc_id != 5 and r.length == r.doc_tokens])
    assert sorted(map(str, C.run(spark, folder).select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(str, after.select("doc_id", "doc_tokens").distinct().collect()))


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    planted(spark, folder)
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    whole.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{folder}/none/benchmark.parquet")
    assert C.run(spark, f"{folder}/none").collect() == []

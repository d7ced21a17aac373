import random
import re
from collections import Counter

import numpy as np
import xxhash

from brevis.llm import simhash as S
from tests.conftest import SF

from .fixtures import empty_documents, odd_documents


def brute_fp(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, reach=2):
    """Root of each fingerprint by comparing all pairs."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in fps}


def want(rows):
    fp = [(i, brute_fp(t)) for i, t in rows]
    root = components([f for _, f in fp])
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return Counter((i, f, least.get(root[f])) for i, f in fp)


def got(docs):
    return Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs).collect())


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert got(docs) == want([(r.doc_id, r.text) for r in docs.collect()])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and 1 in ids and 3 not in ids and 2 in ids and len(ids) == len(set(ids))
    assert S.near_duplicates(empty_documents(spark)).collect() == [] and S.keep_one(empty_documents(spark)).collect() == []


def test_links_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 200)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(1200)]
    fps += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ rng.randrange(2) << rng.randrange(64) for f in fps[:800]]
    center = fps[0]
    fps = sorted({*fps, *(center ^ 1 << b for b in range(64))})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = S.contract(S.links(spark.createDataFrame(signed, "fp long").cache())).collect()
    root = {f[0]: f[0] for f in signed} | {r.node: r.root for r in found}
    groups, truth = {}, components(fps)
    for f, (s,) in zip(fps, signed):
        groups.setdefault(root[s], set()).add(f)
    wanted = {}
    for f in fps:
        wanted.setdefault(truth[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_guests_of_a_shard_are_searched(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base[:700] ^ np.uint64(6)]))
    nodes = S.grow(points, 16)
    which, leaf, home = S.deal(points, nodes, 2)
    assert home.sum() == len(points)
    linked = set()
    for k in set(leaf):
        ix = which[leaf == k]
        a, b = S.spanning(points[ix], home[leaf == k], 2)
        linked |= {frozenset((ix[i], ix[j])) for i, j in zip(a, b)}
    assert len({x for pair in linked for x in pair}) >= 1400


def test_oversized_shards_are_dealt_again(spark, monkeypatch):
    """A close group that no sample of the whole shows: its shard is divided by a tree of its own, and no link is lost."""
    monkeypatch.setattr(S, "SHARD", 100)
    monkeypatch.setattr(S, "SAMPLE", 2)
    monkeypatch.setattr(S, "MOST_SHARDS", 4)
    monkeypatch.setattr(S, "OVERSIZE", 2)
    rng = random.Random(8)
    center = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(600)}
    for _ in range(1500):
        f = center
        for _ in range(rng.randrange(1, 14)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").cache()
    shards = S.dealt(points, 2)
    assert shards.filter("home").count() == len(fps)
    assert shards.select("leaf").distinct().count() > 4
    root = {r.node: r.root for r in S.contract(S.links(points)).collect()}
    groups, truth = {}, {}
    want = components(fps)
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(root.get(s, s), set()).add(f)
        truth.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_other_texts_of_an_equal_fingerprint_are_compared(spark, monkeypatch):
    """Two texts of one fingerprint; a third is similar to the greater of them alone."""
    base = [f"w{i}" for i in range(100)]
    near = ["n0", *base[1:]]
    rows = [(1, " ".join(["other", *(f"v{i}" for i in range(80))])), (2, " ".join(base)), (3, " ".join(near))]
    majority = S.majority
    monkeypatch.setattr(S, "majority", lambda h: 7 if len(h) in (77, 96) and not (h == S.shingle_hashes(rows[2][1], 5)[0]).any() else majority(h) ^ 0xFFFFFFFF)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.keep_one(docs).collect()} == {1}


def shingle_set(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_similar_texts_leave_one(spark, monkeypatch):
    """Groups of texts that differ in whole words, far beyond three bits: what stays is what all pairs at 0.8 leave, also where unlike texts share buckets."""
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            near = list(rng.choice(texts[-3:]))
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(len(near))] = f"n{rng.randrange(5000)}"
            texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (brute_fp(rows[i][1], 5) ^ brute_fp(rows[j][1], 5)).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {find(i) for i in range(len(rows))}
    assert 25 <= len(wanted) < len(rows)
    assert {r.doc_id for r in S.keep_one(docs).collect()} == wanted
    monkeypatch.setattr(S, "HEAP", 2)
    monkeypatch.setattr(S, "ROWS", 1)
    monkeypatch.setattr(S, "band_keys", lambda h, bands, rows: [len(h) // 50, 7][: max(1, bands)] if len(h) else None)
    few = docs.filter("doc_id < 7")  # all of them in one bucket
    assert {r.doc_id for r in S.keep_one(few).collect()} == {min(i for i in range(7) if find(i) == r) for r in {find(i) for i in range(7)}}


def test_contraction_of_paths_and_cycles(spark):
    random.seed(3)
    names = random.sample(range(-1000, 1000), 60)
    edges = list(zip(names[:20], names[1:21])) + [(names[25], x) for x in names[26:40]] + [(x, x) for x in names[41:43]]
    edges += list(zip(names[45:55], names[46:55] + names[45:46])) + [(names[56], names[57]), (names[57], names[56])]
    root = {x: x for x in names}
    for _ in names:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = S.contract(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, root[x]) for x in linked if root[x] != x} and len(got) == len({r.node for r in got})
    assert S.contract(spark.createDataFrame([], "a long, b long")).collect() == []

import time

import numpy as np

from brevis.llm import resample as R
from brevis.llm import toxicity as T
from tests.conftest import SF

from .fixtures import empty_documents, odd_documents

SF1 = SF.replace("0.001", "0.01")


def test_rank_cut(spark):
    values = [5, -3, 2**62, -(2**62), 7, 7, 0, -1, 2**40, 2**17]
    df = spark.createDataFrame([(v,) for v in values], "code long")
    for k in (1, 3, 4, 5, 8, 10):
        assert R.rank_cut(df, k) == sorted(values, reverse=True)[k - 1]
    assert R.rank_cut(df, 11) is None


def test_resampling_prefers_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    got = R.resample(docs, labels).collect()
    assert len(got) == docs.count() and sum(r.kept for r in got) == round(R.KEEP * len(got))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    share = lambda q: np.mean([r.kept for r in got if quality.get(r.doc_id) == q])
    assert share(1) > 0.9 and share(0) < 0.6
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.resample(docs, labels).collect()))


def test_weights_match_their_definition(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    f = R.Features(64)
    raw, target = np.bincount(np.concatenate([f("a b a"), f("b c")]).astype(int), minlength=64), np.bincount(f("a b a").astype(int), minlength=64)
    want = np.log((target + 1) / (target.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    ids = spark.createDataFrame([(1,)], "doc_id long")
    ratios = R.model(docs, ids, 64)
    assert np.allclose(ratios, want)
    got = {r.doc_id: r.log_weight for r in R.scored(docs, ratios).collect()}
    assert np.isclose(got[1], want[f("a b a").astype(int)].sum()) and got[3] == 0


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in T.toxicity(docs, labels).collect() if r.held_out and r.doc_id in toxic]
    caught = [r for r in held if toxic[r.doc_id]]
    assert caught and sum(r.predicted for r in caught) >= 0.75 * len(caught)
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.02 * len(held)


def test_obfuscated_words_are_restored(spark):
    costs = T.trigram_model(spark.createDataFrame([("the idiot and the clown are pathetic " * 50,), ("a moron was here with the loser",)], "text string"))
    read = T.Reader(costs)
    for noisy, word in (("1d10t", "idiot"), ("c10wn", "clown"), ("p@th3t1c", "pathetic"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("idiooooot", "idiot"), ("l0$er", "loser")):
        assert word in read(f"you {noisy} there"), noisy


def test_words_across_a_cut_are_restored(spark):
    costs = T.trigram_model(spark.createDataFrame([("the idiot and the clown are pathetic " * 50,)], "text string"))
    read = T.Reader(costs, longest=12)
    for lead in range(8):
        assert any("idiot" in s for s in read.readings("x9" * lead + "1d10t" + "9x" * 6)), lead


def test_long_runs_take_linear_time():
    costs = np.ones((T.SIZE,) * 3)
    began = time.time()
    for text in ("a" * 1_000_000, "a " * 500_000, "ab." * 300_000 + "9", "a" + "(" * 1_000_000, "abcdefgh" * 125_000, "a1" * 500_000):
        T.Reader(costs)(text, {})
    assert time.time() - began < 30


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, 1, 1), (9, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    got = T.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len(R.resample(docs, labels).collect()) == docs.count()
    for none in (labels.limit(0), labels):
        assert T.toxicity(empty_documents(spark), none).collect() == [] and R.resample(empty_documents(spark), none).collect() == []

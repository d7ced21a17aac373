import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from brevis.llm import packing, records
from brevis.llm.encode import WordEncoder
from brevis.llm.queries import vocabulary
from tests.conftest import SF

from .fixtures import empty_documents, odd_documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tokenizer):
    random.seed(3)
    code, signs = WordEncoder(vocabulary(), 4, keep=50), "aAbé É́İß.,'s<|endoftext|>\n\t\r\x1c\x85  🌍0９ "
    texts = ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(400)] + ["It's <|endoftext|> end", "<|endoftext|>", "ΣΑΣ σας", "  "]
    for t in texts:
        assert np.frombuffer(code.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("kind", ["table", "odd", "empty"])
def test_records_round_trip(spark, tokenizer, kind):
    docs = {"table": lambda s: s.read.parquet(f"{SF}/documents.parquet"), "odd": odd_documents, "empty": empty_documents}[kind](spark)
    want, start = [], 0
    for i, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = ids_of(tokenizer, t, 1)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = records.token_records(spark, docs, vocabulary()).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    out = f"file://{tmp_path}/x"
    manifest = records.write_shards(docs, out, vocabulary())
    fs, _ = records.open_store(out)
    i, at, n = records.read_index(fs, manifest[0].offsets)[2]
    got, ids = records.read_record(fs, manifest[0].data, at)
    assert got == i == 2 and len(ids) // 2 == n
    data = bytearray(open(manifest[0].data, "rb").read())
    data[at + 15] ^= 1
    open(manifest[0].data, "wb").write(data)
    with pytest.raises(records.CorruptRecord):
        records.read_record(fs, manifest[0].data, at)
    with pytest.raises(Exception, match="checksum"):
        records.read_shards(spark, manifest, out).collect()
    assert SimpleNamespace(**manifest[0].asDict()).n_docs > 0


@pytest.mark.parametrize("kind", ["table", "odd", "empty"])
def test_packing(spark, tokenizer, kind):
    docs = {"table": lambda s: s.read.parquet(f"{SF}/documents.parquet"), "odd": odd_documents, "empty": empty_documents}[kind](spark)
    got = packing.pack(docs, vocabulary(), pool_tokens=20_000).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and {r.sequence_tokens for r in rows} == {at}
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(ids_of(tokenizer, r.text, 2))
    assert want.keys() == pieces.keys()
    for i, all_ids in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, all_ids))
        for r in pieces[i]:
            assert any(r.doc_tokens == len(ids) and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in all_ids)
        if len(all_ids) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    totals = defaultdict(int)
    for rows in windows.values():
        totals[rows[0].step_id] += rows[0].sequence_tokens
    assert not got or max(totals.values()) <= 2 * (1 << 16)


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    code, own = WordEncoder(path, 4), Tokenizer.from_file(path)
    assert not code.by_words and WordEncoder(vocabulary(), 4).by_words
    for t in ("It's  two blanks\n\tand a tab", "Ünïcode 世界 🌍", "a <|endoftext|> b"):
        assert np.frombuffer(code.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_a_hot_id_is_many_tasks_work(spark, tokenizer):
    docs = spark.createDataFrame([(None, f"text {i % 40}") for i in range(400)] + [(7, "same")] * 300 + [(1, "one")], "doc_id long, text string")
    got = sorted(records.token_records(spark, docs, vocabulary()).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == [None] * 400 + [1] + [7] * 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one task's
    try:
        manifest = records.write_shards(docs, f"{spark.sparkContext.getCheckpointDir()}/hot", vocabulary())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(m.n_docs for m in manifest) < 400


def test_windows_against_the_best_fill(spark):
    """No packer can use fewer windows than the tokens fill, nor cut fewer than their ends force: one cut a window at most."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    got = packing.pack(docs, vocabulary()).collect()
    sizes = {r.sequence_id: r.sequence_tokens for r in got}
    total = sum({(r.doc_id): r.doc_tokens for r in got}.values())
    assert sum(sizes.values()) == total
    tiers = packing.TIERS
    assert sum(v not in tiers for v in sizes.values()) <= 12  # the powers of two of the rest
    # as if each document went to the shortest tier that holds it, without a gap
    least = sum(-(-r // tiers[-1]) for r in {r.doc_id: r.doc_tokens for r in got}.values()) - docs.count()
    assert len(got) - docs.count() <= len(sizes) + least

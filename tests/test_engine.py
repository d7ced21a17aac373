import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis import catalog
from brevis.functions import bits as B
from brevis.operators import chunks as C
from brevis.operators import coder as K
from brevis.operators import models as M
from brevis.operators import sessions as S
from brevis.operators.coder import Decoder, Encoder, coded
from brevis.plans import compress as P
from brevis.sources import containers as H
from brevis.sources import tokenizers as T

from .conftest import SF

TEXTS = ["", "a", "Hello, 世界! 🌍", "Test\x00\x01\x02with\nspecial\tchars", "﻿BOM", "  \t\n\r  ", "the " * 200]


def slow_bits(ranges):
    """The textbook bit-by-bit coder."""
    low, high, pending, out = 0, 2**32 - 1, 0, []

    def emit(b):
        nonlocal pending
        out.extend([b] + [1 - b] * pending)
        pending = 0

    for lo, hi, total in ranges:
        width = high - low + 1
        low, high = low + width * lo // total, low + width * hi // total - 1
        while True:
            if high < 2**31:
                emit(0)
            elif low >= 2**31:
                emit(1)
                low, high = low - 2**31, high - 2**31
            elif low >= 2**30 and high < 3 * 2**30:
                pending += 1
                low, high = low - 2**30, high - 2**30
            else:
                break
            low, high = 2 * low, 2 * high + 1
    pending += 1
    emit(0 if low < 2**30 else 1)
    out += [0] * (-len(out) % 8)
    return bytes(int("".join(map(str, out[i : i + 8])), 2) for i in range(0, len(out), 8))


def test_coders_agree_and_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for size in (1, 5, 60, 300):
        counts = [rng.choice([1, 2, 50, 20_000]) for _ in range(9)]
        cdf = [sum(counts[:i]) for i in range(10)]
        syms = rng.choices(range(9), counts, k=size)
        rows.append((cdf, syms, [(cdf[s], cdf[s + 1], cdf[-1]) for s in syms]))
    df = spark.createDataFrame([(r[2],) for r in rows], "r array<struct<lo:bigint,hi:bigint,total:bigint>>")
    native = [bytes(x[0]) for x in df.select(coded(F.col("r"))).collect()]
    for (cdf, syms, ranges), got in zip(rows, native):
        coder = Encoder()
        for r in ranges:
            coder.push(*r)
        data = coder.finish()
        assert data == slow_bits(ranges) == got
        pull = Decoder(data).pull
        assert [pull(cdf) for _ in syms] == syms


def test_texts_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model, want = P.train(docs), dict(enumerate(TEXTS))
    packed = P.compress(docs, model)
    assert {r.doc_id: r.text for r in P.decompress(packed, model).collect()} == want
    assert {len(r.data) for r in packed.filter("doc_id = 0").collect()} == {25}
    for size, overlap in ((128, 16), (5, 9), (64, 0)):
        whole = P.compress_chunked(docs, model, size, overlap)
        assert {r.doc_id: r.text for r in P.decompress_chunked(whole, model).collect()} == want
    with pytest.raises(Exception, match="another model"):
        P.decompress(packed, P.Model([*range(257)])).collect()


def test_lanes_agree_with_single_streams():
    rng = np.random.default_rng(3)
    table = np.concatenate([np.zeros((40, 1), np.int64), rng.integers(1, 3000, (40, 40)).cumsum(1)], 1)
    for model in (M.Model(table[0]), M.Model(table), M.MockModel(40)):
        for few in (1, 5, 10**9):
            K.FEW = few
            streams = [rng.integers(0, 40, n) for n in (0, 1, 2, 300, 7, 0, 150, 33, 33, 900)]
            got = model.encode(streams)
            for s, data in zip(streams, got):
                coder, last = Encoder(), 0
                for t, x in enumerate(s.tolist()):
                    row = model.row(last, t)
                    coder.push(row[x], row[x + 1], row[-1])
                    last = x
                assert data == (coder.finish() if len(s) else b"")
            assert [x.tolist() for x in model.decode(got, [len(s) for s in streams])] == [s.tolist() for s in streams]
    K.FEW = 24


def test_mock_model_is_the_queried_one(spark):
    want = {(r.prev, r.pos, r.sym): (r.lo, r.hi, r.total) for r in catalog.q_mock_cdf(spark, SF).collect()}
    model = M.MockModel(320)
    for prev in range(8):
        for pos in range(8):
            row = model.row(prev, pos)
            assert all(want[prev, pos, s] == (row[s], row[s + 1], row[-1]) for s in range(320))


def test_sessions():
    s = S.MockSession(64)
    s.reset()
    first = s.process_tokens([3, 9, 1])
    held = s.get_state()
    after = s.process_token(5)
    s.set_state(held)
    assert (s.process_token(5) == after).all() and not (s.process_token(5) == after).all()
    s.reset()
    assert all((a == b).all() for a, b in zip(first, s.process_tokens([3, 9, 1])))
    model = S.SessionModel(lambda: S.MockSession(64), 64, s.hash)
    streams = [np.array(x, np.int64) for x in ([], [1], [5, 9, 63, 0, 5])]
    packed = model.encode(streams)
    assert [x.tolist() for x in model.decode(packed, [0, 1, 5])] == [x.tolist() for x in streams]
    # a session's streams are those of the table-free model, which knows position and the symbol before as well
    assert packed == M.MockModel(64).encode(streams)


def test_neural_session_feeds_states_back():
    class Runtime:
        def __init__(self):
            self.seen = []

        def run(self, names, feeds):
            self.seen.append((names, {k: v.copy() for k, v in feeds.items()}))
            return [np.arange(6, dtype=np.float32), *(feeds[k] + 1 for k in S.NeuralSession.STATES)]

    runtime = Runtime()
    s = S.NeuralSession(runtime, layers=2, width=3, size=6, context=8)
    assert s.hash == 2_003_006 and (s.state["pp_att"] == np.float32(-1e30)).all()
    p = s.process_token(4)
    s.process_token(5)
    names, feeds = runtime.seen[1]
    assert names == ["x", "xx_att_r", "aa_att_r", "bb_att_r", "pp_att_r", "xx_ffn_r"] and feeds["idx"].tolist() == [0] * 7 + [5]
    assert (feeds["xx_att"] == 1).all() and p.dtype == np.float32 and abs(p.sum() - 1) < 1e-6
    s.reset()
    assert (s.state["aa_att"] == 0).all()


def test_chunked_form_with_any_key(spark):
    rows = [(None, "no key " * 40), (5, "first of five " * 30), (5, "second of five " * 50), (6, None), (7, ""), (None, "no key either")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for model in (P.train(docs), P.train(docs, order=1), M.MockModel(256)):
        for size, overlap in ((128, 16), (4, 9)):
            packed = P.compress_chunked(docs, model, size, overlap)
            got = P.decompress_chunked(packed, model).collect()
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
            assert {r.ok for r in got if r.text is not None} == {True} and [r.ok for r in got if r.text is None] == [None]
        whole = P.decompress(P.compress(docs, model), model).collect()
        assert sorted(((r.doc_id, r.text) for r in whole), key=str) == sorted(rows, key=str)


def test_context_counts_take_fewer_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda model: P.compress(docs, model).agg(F.sum(F.length("data"))).first()[0]
    assert size(P.train(docs, order=1)) < 0.95 * size(P.train(docs))


def test_bad_containers_raise(spark):
    docs = spark.createDataFrame([(1, "some text of some length " * 9)], "doc_id long, text string")
    model = P.train(docs)
    other = M.Model([*range(257)])
    whole, parts = (bytes(f(docs, model).first().data) for f in (P.compress, P.compress_chunked))
    cases = [(P.decompress, b"LL", "Invalid header"), (P.decompress, b"XXXX" + whole[4:], "Invalid file format"), (P.decompress, b"LLMC\x02" + whole[5:], "Unsupported format version")]
    cases += [(P.decompress_chunked, b"LL", "Invalid chunked header"), (P.decompress_chunked, whole, "not a chunked compressed file"), (P.decompress_chunked, b"LLMP\x02" + parts[5:], "Unsupported chunked format version"), (P.decompress_chunked, parts[:27], "Invalid chunked header")]
    for f, data, message in cases:
        with pytest.raises(Exception, match=message):
            f(spark.createDataFrame([(1, data)], "doc_id long, data binary"), model).collect()
    for f, data in ((P.decompress, whole), (P.decompress_chunked, parts)):
        with pytest.raises(Exception, match="another model"):
            f(spark.createDataFrame([(1, data)], "doc_id long, data binary"), other).collect()
    with pytest.raises(Exception, match="more than 65,535 chunks"):
        P.compress_chunked(spark.createDataFrame([(1, "x" * 70_000)], "doc_id long, text string"), model, 1, 0).collect()


def test_large_vocabularies(spark):
    rng = random.Random(9)

    def loop(t, parts):
        while True:
            best = min(zip(parts, parts[1:]), key=lambda p: t.ranks.get(p, 1 << 30), default=None)
            if best not in t.ranks:
                return parts
            out, i = [], 0
            while i < len(parts):
                two = tuple(parts[i : i + 2]) == best
                out.append("".join(parts[i : i + 2]) if two else parts[i])
                i += 1 + two
            parts = out

    for _ in range(60):
        alphabet = "abc"
        merges, made = [], list(alphabet)
        for _ in range(rng.randrange(1, 12)):
            a, b = rng.choice(made), rng.choice(made)
            merges.append([a, b])
            made.append(a + b)
        rng.shuffle(merges)
        t = T.Tokenizer({c: i for i, c in enumerate([*B.byte_alphabet(), *made])}, merges)
        for _ in range(20):
            parts = [rng.choice(alphabet) for _ in range(rng.randrange(30))]
            assert t.apply(parts) == loop(t, parts) == t.split("".join(parts)), (merges, parts)
    t = catalog.from_file(spark)
    assert t.size == 50_256 and t.added == {"<|endoftext|>": 50_256} and not t.native
    docs = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    for r in docs.select("text", t.ids(F.col("text")).alias("ids"), t.pieces(F.col("text")).alias("p")).collect():
        assert r.p == loop(t, [B.byte_alphabet()[b] for b in r.text.encode()]) and [t.tokens[i] for i in r.ids] == r.p
    found = {r.token: r.id for r in t.look_up(spark.createDataFrame([("Ġthe",), ("<|endoftext|>",)], "token string")).collect()}
    assert found == {"Ġthe": t.vocab["Ġthe"], "<|endoftext|>": None}
    assert spark.createDataFrame([([50_256, 15, 99_999],)], "i array<int>").select(t.text(F.col("i"))).first()[0] == t.tokens[15]


def test_command_line(spark, tmp_path):
    from brevis.__main__ import main

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    src, model, out, back = (str(tmp_path / x) for x in ("in", "model", "out", "back"))
    docs.write.parquet(src)
    main(["train", src, model, "--context"])
    for chunked in ([], ["--chunked"]):
        main(["compress", src, out, "--model", model, *chunked])
        main(["decompress", out, back, "--model", model, *chunked])
        assert {r.doc_id: r.text for r in spark.read.parquet(back).collect()} == dict(enumerate(TEXTS))


def test_chunks_and_their_limits(spark):
    got = spark.range(1).select(F.explode(C.split_tokens(F.sequence(F.lit(1), F.lit(15)), 5, 2)).alias("c")).select("c.*").collect()
    assert [r.tokens for r in got] == [[*range(1, 6)], [*range(4, 11)], [*range(9, 16)]] and [r.output_start for r in got] == [0, 5, 10]
    for size, overlap in ((0, 1), (5, -1), (65_000, 600)):
        with pytest.raises(ValueError):
            C.validate(size, overlap)


def test_headers(spark):
    values = [(1000, 50, 0x12345678), (2**32 - 1,) * 3, (0, 0, 0)]
    df = spark.createDataFrame(values, "a long, b long, c long").select("*", H.pack_header(F.col("a"), F.col("b"), F.col("c")).alias("h"))
    for r in df.select("*", H.unpack_header(F.col("h")).alias("u")).collect():
        assert bytes(r.h) == struct.pack("<4sBIII8x", b"LLMC", 1, r.a, r.b, r.c)
        assert (r.u.original_length, r.u.token_count, r.u.model_hash) == (r.a, r.b, r.c)
    bad = spark.createDataFrame([(b"LLMC" + bytes(6),), (b"XXXX" + bytes(21),), (b"LLMC\xff" + bytes(20),)], "d binary")
    assert [r[0] for r in bad.select(H.status(F.col("d"))).collect()] == ["Invalid header", "Invalid file format", "Unsupported format version"]
    with pytest.raises(Exception, match="32 bits"):
        spark.range(1).select(H.pack_header(F.lit(1 << 32), F.lit(0), F.lit(0))).collect()


def test_bytes_and_tokens(spark):
    docs, t = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), T.small()
    assert t.native
    for r in docs.select("text", B.decode_bytes(B.encode_bytes(F.col("text"))).alias("b"), t.pieces(F.col("text")).alias("p"), t.text(t.ids(F.col("text"))).alias("d")).collect():
        assert r.b == r.text == r.d
        chars = "".join(B.byte_alphabet()[b] for b in r.text.encode())
        assert r.p == t.apply(list(chars))
    odd = T.Tokenizer({c: i for i, c in enumerate([*B.byte_alphabet(), "ab", "bc", "abc"])}, ["b c", "a b", "ab c", "a bc"])
    assert not odd.ordered and docs.sparkSession.createDataFrame([("abcab",)], "text string").select(odd.pieces(F.col("text"))).first()[0] == ["abc", "ab"]
    broken = spark.createDataFrame([("Ãðx€",)], "s string")
    assert "�" in broken.select(B.decode_bytes(F.col("s"))).first()[0]


FAST = ["q_utf8_size", "q_byte_alphabet", "q_byte_encode", "q_bpe_merge", "q_header_pack", "q_chunks", "q_chunked_header_pack", "q_cdf", "q_code_length", "q_entropy", "q_context", "q_mock_cdf", "q_zipf_cdf", "q_bits_pack", "q_bits_unpack", "q_bit_count", "q_token_lookup", "q_vocab_size", "q_first_diff", "q_compress_chunked", "q_chunk_payloads", "q_ac_encode", "q_ac_decode", "q_code_length_context", "q_roundtrip_context"]


@pytest.mark.parametrize("name", FAST)
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_stream(spark, tmp_path):
    from brevis.streaming.compress import compress_stream

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = compress_stream(spark, str(tmp_path / "in"), "doc_id long, text string", P.train(docs))
    q = stream.writeStream.format("memory").queryName("packed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("packed").count() == len(TEXTS)

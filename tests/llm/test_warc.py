import hashlib
import io
import struct
from collections import Counter

import pytest
import zstandard

from brevis.llm import warc as W
from tests.conftest import SF


def want(rows):
    first, out = {}, Counter()
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    for i, _, html in rows:
        p = (html or "").encode()
        f = first.get(p)
        again = f is not None and i is not None and f < i
        out[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None] += 1
    return out


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    body = pages.first().html
    more = [(9001, "http://x/ a\r\nb", body), (9002, None, body), (9003, "u", None), (9004, "u", ""), (9005, "u", "short"), (9006, "u", "short"), (None, "u", body), (9007, "u", "é" * 50), (9008, "u", "é" * 50), (9009, "u", "\r\n\r\nx" * 40_000)]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string, html string"))
    got = Counter(map(tuple, W.archive(spark, pages).collect()))
    assert got == want([tuple(r) for r in pages.collect()])
    assert W.archive(spark, pages.limit(0)).collect() == []


def test_reader_checks():
    good = W.record(1, "http://a", "response", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert W.read_page(good)[0] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"hello", b"hellO"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(W.BadArchive):
            W.read_page(bad)


def test_dictionary_comes_first():
    dictionary = zstandard.train_dictionary(2000, [f"some sample text {i} of pages {i * 7}".encode() * 5 for i in range(400)])
    pack = zstandard.ZstdCompressor(dict_data=dictionary)
    rows = [b"one record", b"", b"x" * 3_000_000]
    for body in (dictionary.as_bytes(), zstandard.compress(dictionary.as_bytes())):
        data = struct.pack("<II", W.SKIPPABLE, len(body)) + body + b"".join(map(pack.compress, rows))
        assert list(W.frames(io.BytesIO(data))) == rows
        assert list(W.frames(io.BytesIO(data), chunk=7)) == rows
        with pytest.raises(W.BadArchive):
            list(W.frames(io.BytesIO(data[:-3])))
    assert list(W.frames(io.BytesIO(zstandard.compress(b"plain")))) == [b"plain"] and list(W.frames(io.BytesIO(b""))) == []


def test_revisits_name_their_record():
    digest = hashlib.sha256(b"x" * 200).hexdigest()
    first, again = (W.parse(W.record(i, "http://a", kind, b"x" * 200, digest, to))[0] for i, kind, to in ((3, "response", None), (8, "revisit", 3)))
    assert again["warc-refers-to"] == first["warc-record-id"] != again["warc-record-id"]
    with pytest.raises(W.BadArchive, match="over 1000"):
        list(W.frames(io.BytesIO(zstandard.compress(bytes(5000))), most=1000))

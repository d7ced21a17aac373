import hashlib
import math
import random
import re
import time
from collections import Counter

from brevis.llm import secrets
from tests.conftest import SF

from .fixtures import empty_documents, odd_documents

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    shown = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(s))
    found = list(spans)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text):
        v = m[0]
        hexed = re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)
        if not re.search("[0-9]", v) or any(re.search(x, v) for x in secrets.ALLOWED) or any(a < m.end() and m.start() < z for a, _, z in spans):
            continue
        if not hexed and not (re.search("[A-Za-z]", v) and re.search("[0-9].*[0-9]", v)):
            continue
        peak = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(v[i : i + 20]).values()) for i in range(len(v) - 19))
        if peak >= (secrets.HEX_LIMIT if hexed else secrets.MIXED_LIMIT):
            found.append((m.start(), 3, m.end()))
    return *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(shown(spans).encode()).hexdigest(), shown(found)


def check(df):
    texts = Counter((r.doc_id, *brute(r.text or "")) for r in df.collect())
    assert Counter(tuple(r) for r in secrets.secrets(df).collect()) == texts
    return texts


def test_matches_brute_force(spark):
    found = check(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    assert any(x[1] or x[2] or x[3] for x in found)


def test_shapes(spark):
    texts = [
        "secret: token: abcdefgh and token: abcdefgh", "API_KEY = 'abc' apikey=abcdef", "🌍 password=hunter22 AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 12,
        "x " + "0123456789abcdef" * 2, "id q8Zk3LmN0pXv7RtYw2Bc5DfGh1Jk9 end", "550e8400-e29b-41d4-a716-446655440000", "9F3A7C51D28E04B6A1C3 token==abcdefg",
        "kT5_vP9-xW2/qM7+rN4zB8cL1 and again kT5_vP9-xW2/qM7+rN4zB8cL1", "version-of-something-long-2024", "example9k3jf02jf8ah3k20dkf93", "password=secretsecret=abcdef",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_odd_rows(spark):
    check(odd_documents(spark))
    assert secrets.secrets(empty_documents(spark)).collect() == []


def test_long_texts_take_linear_time(spark):
    rng = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choices(signs, k=200_000)), "token=abcdefgh1 " * 20_000, "a-" * 100_000 + "1b2", "x" * 200_000, " ".join("".join(rng.choices(signs, k=24)) for _ in range(8_000))]
    began = time.time()
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert time.time() - began < 120

"""The queries of the engine and their SQL for another engine. Names of columns agree on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import bits as B
from .operators import chunks as C
from .operators import models as M
from .plans import compress as P
from .sources import containers as H
from .sources import tokenizers as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIZE, OVERLAP = 128, 16
SWEEP = [(64, 8), (128, 16), (256, 32), (128, 0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


# SQL pieces
ALPHA = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in B.byte_alphabet()) + "]"
BYTES = "SELECT doc_id, lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS pos FROM documents"
SYMS = f"SELECT doc_id, lang, pos, ('0x' || h)::INTEGER AS sym FROM ({BYTES})"
CDF = f"""WITH s AS ({SYMS}), c AS (SELECT sym, count(*) AS n FROM s GROUP BY sym), t AS (SELECT sum(n) AS al FROM c),
 e AS (SELECT r.range::INTEGER AS sym, coalesce(n / al::DOUBLE, 0) AS p FROM range(256) r CROSS JOIN t LEFT JOIN c ON c.sym = r.range),
 q AS (SELECT sym, greatest(1, floor(p::FLOAT::DOUBLE * 65536))::BIGINT AS n FROM e),
 cdf AS (SELECT sym, (sum(n) OVER (ORDER BY sym) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY sym))::BIGINT AS hi, (sum(n) OVER ())::BIGINT AS total FROM q)"""
LE = lambda x, w: " || ".join(f"substr(printf('%0{2 * w}X', ({x})::BIGINT), {2 * k + 1}, 2)" for k in reversed(range(w)))
HEAD = f"'4C4C4D43' || '01' || {LE('octet_length(encode(text))', 4)} || {LE('length(text)', 4)} || {LE('12818277', 4)} || '0000000000000000'"
ENCODED = f"array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: {ALPHA}[('0x' || h)::INTEGER + 1]), '')"
MERGED = f"regexp_replace({ENCODED}, '(.)', chr(1) || '\\1' || chr(2), 'g')"
for _m in T.MERGES:
    _a, _b = _m.split(" ")
    MERGED = f"replace({MERGED}, chr(1) || '{_a}' || chr(2) || chr(1) || '{_b}' || chr(2), chr(1) || '{_a}{_b}' || chr(2))"
# The coder as a fold over a list of {lo, hi, total}: sequential lets, then the closed-form renormalisation.
LET = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
STEP = LET(
    "{'l': s.low + (s.high - s.low + 1) * r.lo // r.total, 'h': s.low + (s.high - s.low + 1) * r.hi // r.total - 1}", "v",
    LET(
        "{'l': v.l, 'h': v.h, 'n': 32 - CASE WHEN v.l = v.h THEN 0 ELSE length(bin(xor(v.l, v.h))) END, 'b': lpad(bin(v.l), 32, '0')}", "u",
        LET(
            "{'l': (u.l << u.n) & 4294967295, 'h': ((u.h << u.n) | ((1::BIGINT << u.n) - 1)) & 4294967295, 'n': u.n, 'o': CASE WHEN u.n > 0 THEN u.b[1] || repeat(CASE u.b[1] WHEN '1' THEN '0' ELSE '1' END, s.pend) || substr(u.b, 2, u.n - 1) ELSE '' END}", "w",
            LET(
                "{'l': w.l, 'h': w.h, 'n': w.n, 'o': w.o, 'k': CASE WHEN ((4294967295 - w.l) | w.h) & 2147483647 = 0 THEN 31 ELSE 31 - length(bin(((4294967295 - w.l) | w.h) & 2147483647)) END}", "z",
                "{'low': CASE WHEN z.k > 0 THEN (z.l << z.k) & 2147483647 ELSE z.l END, 'high': CASE WHEN z.k > 0 THEN (((z.h << z.k) | ((1::BIGINT << z.k) - 1)) & 4294967295) | 2147483648 ELSE z.h END, 'pend': (CASE WHEN z.n > 0 THEN 0 ELSE s.pend END + z.k)::BIGINT, 'bits': s.bits || z.o}",
            ),
        ),
    ),
)
FIRST = "{'low': 0::BIGINT, 'high': 4294967295::BIGINT, 'pend': 0::BIGINT, 'bits': ''}"
DONE = lambda f: f"unbin(rpad(x, (ceil(length(x) / 8) * 8)::INTEGER, '0'))".replace("x", f"({f}.bits || CASE WHEN {f}.low < 1073741824 THEN '0' || repeat('1', {f}.pend + 1) ELSE '1' || repeat('0', {f}.pend + 1) END)")
RANGES = f"{CDF}, m AS (SELECT list({{'lo': lo, 'hi': hi, 'total': total}} ORDER BY sym) AS ivs FROM cdf), b AS (SELECT doc_id, lang, source, octet_length(encode(text))::BIGINT AS n, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INTEGER) AS t FROM documents)"
#: Whole texts are folded in parts, or the bits would be copied for each symbol.
WHOLE = f"{RANGES}, w AS (SELECT doc_id, lang, source, n, list_reduce(range(0, n, 512), lambda a, g: " + LET(f"list_reduce(list_transform(t[g + 1 : g + 512], lambda q: ivs[q + 1]), lambda s, r: {STEP}, {{'low': a.low, 'high': a.high, 'pend': a.pend, 'bits': ''}})", "e", "{'low': e.low, 'high': e.high, 'pend': e.pend, 'bits': a.bits || e.bits}") + f", {FIRST}) AS f FROM b CROSS JOIN m), p AS (SELECT doc_id, lang, source, n, CASE WHEN n = 0 THEN ''::BLOB ELSE {DONE('f')} END AS payload FROM w)"
CODED = lambda size, overlap: f"k AS (SELECT doc_id, n, unnest(list_transform(range(ceil(n / {size}.0)::BIGINT), lambda k: {{'k': k, 't': t[greatest(0, k * {size} - {overlap}) + 1 : least(n, (k + 1) * {size})]}})) AS c FROM b), f AS (SELECT doc_id, n, c.k AS k, c.t AS t, list_reduce(list_transform(c.t, lambda q: ivs[q + 1]), lambda s, r: {STEP}, {FIRST}) AS f FROM k CROSS JOIN m), cp AS (SELECT doc_id, n, k, t, {DONE('f')} AS payload FROM f)"
NCHUNKS = f"ceil(octet_length(encode(text)) / {SIZE}::DOUBLE)::INTEGER"


def packed(text: str = "text"):
    return H.pack_header(F.octet_length(text), F.length(text), F.lit(M.LAYERS * 1_000_000 + M.WIDTH * 1_000 + M.VOCABULARY))


@query("SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes FROM documents")
def q_utf8_size(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n_bytes"))


@query(f"SELECT range::BIGINT AS byte, {ALPHA}[range + 1] AS ch FROM range(256)")
def q_byte_alphabet(spark, sf_dir):
    plain = F.col("id").between(0x21, 0x7E) | F.col("id").between(0xA1, 0xAC) | (F.col("id") >= 0xAE)
    rows = spark.range(256).withColumn("plain", plain)
    nth = F.sum((~F.col("plain")).cast("int")).over(W.orderBy("id"))
    return rows.select(F.col("id").alias("byte"), F.when(plain, F.decode(F.unhex(F.lpad(F.hex("id"), 2, "0")), "ISO-8859-1")).otherwise(F.decode(F.unhex(F.lpad(F.hex(nth + 255), 4, "0")), "UTF-16BE")).alias("ch"))


@query(f"SELECT doc_id, md5({ENCODED}) AS digest FROM documents")
def q_byte_encode(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.md5(B.encode_bytes(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_byte_decode(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.md5(B.decode_bytes(B.encode_bytes(F.col("text"))).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(replace(replace({MERGED}, chr(1), ''), chr(2), ' ')) AS digest FROM documents")
def q_bpe_merge(spark, sf_dir):
    joined = F.concat(F.array_join(T.small().pieces(F.col("text")), " "), F.when(F.octet_length("text") > 0, " ").otherwise(""))
    return docs_of(spark, sf_dir).select("doc_id", F.md5(joined.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, (length(x) - length(replace(x, chr(1), '')))::INTEGER AS n_tokens FROM (SELECT doc_id, {MERGED} AS x FROM documents)")
def q_token_counts(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.size(T.small().pieces(F.col("text"))).alias("n_tokens"))


@query(f"""WITH v AS (SELECT unnest({ALPHA[:-1]}, {', '.join("'" + m.replace(' ', '') + "'" for m in T.MERGES)}]) AS token, generate_series - 1 AS id FROM generate_series(1, 1)),
 w AS (SELECT token, (row_number() OVER () - 1)::INTEGER AS id FROM (SELECT unnest({ALPHA[:-1]}, {', '.join("'" + m.replace(' ', '') + "'" for m in T.MERGES)}]) AS token)),
 t AS (SELECT unnest(string_split(rtrim(replace({MERGED}, chr(1), ''), chr(2)), chr(2))) AS token FROM documents)
 SELECT w.id, count(*) AS n FROM t JOIN w ON t.token = w.token GROUP BY w.id""")
def q_bpe_encode(spark, sf_dir):
    return docs_of(spark, sf_dir).select(F.explode(T.small().ids(F.col("text"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_bpe_decode(spark, sf_dir):
    t = T.small()
    return docs_of(spark, sf_dir).select("doc_id", F.md5(t.text(t.ids(F.col("text"))).cast("binary")).alias("digest"))


TOKENS = f"SELECT token, (row_number() OVER () - 1)::BIGINT AS id FROM (SELECT unnest({ALPHA[:-1]}, {', '.join("'" + m.replace(' ', '') + "'" for m in T.MERGES)}]) AS token)"


@query(f"WITH v AS ({TOKENS}) SELECT q.range::BIGINT AS id, token FROM range(200, 320) q LEFT JOIN v ON v.id = q.range")
def q_token_lookup(spark, sf_dir):
    """Tokens of ids, null where there is none."""
    return T.small().look_up(spark.range(200, 320).select("id")).select("id", "token")


@query(f"WITH v AS ({TOKENS}) SELECT count(*) AS tokenizer, max(id) + 1 AS ids, {M.VOCABULARY}::BIGINT AS model FROM v")
def q_vocab_size(spark, sf_dir):
    t = T.small()
    rows = t.table(spark).agg(F.count("*").alias("tokenizer"), (F.max("id") + 1).cast("long").alias("ids"))
    return rows.withColumn("model", F.lit(M.VOCABULARY).cast("long"))


#: A byte-level vocabulary file in tokenizer JSON; another path may be given.
VOCABULARY_FILE = "byte_bpe_50k.json"


def from_file(spark, path=None):
    import public_tokenizers

    return T.load(spark, path or "file://" + public_tokenizers.path(VOCABULARY_FILE))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_bpe_file_roundtrip(spark, sf_dir):
    """Texts through the ids of a vocabulary file and back."""
    t = from_file(spark)
    return docs_of(spark, sf_dir).select("doc_id", t.ids(F.col("text")).alias("ids")).select("doc_id", F.md5(t.text(F.col("ids")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {HEAD} AS header FROM documents")
def q_header_pack(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.hex(packed()).alias("header"))


@query("SELECT doc_id, 'ok' AS status, 1::BIGINT AS version, octet_length(encode(text))::BIGINT AS original_length, length(text)::BIGINT AS token_count, 12818277::BIGINT AS model_hash FROM documents")
def q_header_unpack(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", H.unpack_header(packed()).alias("h")).select("doc_id", "h.*")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'Invalid header' WHEN 2 THEN 'Invalid file format' ELSE 'Unsupported format version' END AS status, doc_id % 4 = 2 AS chunked FROM documents")
def q_detect_format(spark, sf_dir):
    h, k = packed(), F.col("doc_id") % 4
    made = F.when(k == 0, h).when(k == 1, F.substring(h, 1, 10)).when(k == 2, F.concat(F.unhex(F.lit("4C4C4D50")), F.substring(h, 5, 21))).otherwise(F.concat(F.substring(h, 1, 4), F.unhex(F.lit("FF")), F.substring(h, 6, 20)))
    return docs_of(spark, sf_dir).select("doc_id", H.status(made).alias("status"), H.is_chunked(made).alias("chunked"))


@query(f"SELECT doc_id, base64(unhex({HEAD})) AS b64 FROM documents")
def q_base64(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.base64(packed()).alias("b64"))


@query("SELECT 12818277::BIGINT AS model_hash")
def q_model_hash(spark, sf_dir):
    return spark.range(1).select(F.expr(f"{M.LAYERS} * 1000000L + {M.WIDTH} * 1000L + {M.VOCABULARY}L").alias("model_hash"))


def chunk_rows(spark, sf_dir, size=SIZE, overlap=OVERLAP):
    return C.exploded(docs_of(spark, sf_dir), P.byte_tokens(F.col("text")), size, overlap, "doc_id")


CHUNKS = "SELECT doc_id, k::INTEGER AS chunk_id, (least(n, (k + 1) * {s}) - greatest(0, k * {s} - {o}))::INTEGER AS n_tokens, (k * {s})::INTEGER AS output_start, (least(n, (k + 1) * {s}) - k * {s})::INTEGER AS output_count FROM (SELECT doc_id, n, unnest(range(ceil(n / {s}::DOUBLE)::BIGINT)) AS k FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents))"


@query(CHUNKS.format(s=SIZE, o=OVERLAP))
def q_chunks(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", F.size("tokens").alias("n_tokens"), "output_start", "output_count")


@query(" UNION ALL ".join(f"SELECT {s} AS chunk_size, {o} AS overlap_size, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS coded_tokens FROM ({CHUNKS.format(s=s, o=o)})" for s, o in SWEEP))
def q_chunk_sweep(spark, sf_dir):
    docs, out = docs_of(spark, sf_dir).select("doc_id", P.byte_tokens(F.col("text")).alias("tokens")), None
    for s, o in SWEEP:
        one = C.exploded(docs, F.col("tokens"), s, o).agg(F.count("*").alias("n_chunks"), F.sum(F.size("tokens")).alias("coded_tokens")).select(F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap_size"), "*")
        out = one if out is None else out.union(one)
    return out


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def q_chunk_merge(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", C.own_tokens(F.col("tokens"), F.col("output_count")).alias("own"))
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "own"))).alias("c"))
    chars = F.array_join(F.transform(F.flatten(F.transform("c", lambda x: x["own"])), lambda t: F.lpad(F.hex(t), 2, "0")), "")
    return whole.select("doc_id", F.md5(F.unhex(chars)).alias("digest"))


def layout(spark, sf_dir):
    """Offsets and counts of chunks that are stored as they are, one byte for each token."""
    docs = docs_of(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n"))
    k = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.ceil(F.col("n") / SIZE).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    counts = F.transform(k, lambda i: F.least("n", (i + 1) * SIZE) - F.greatest(F.lit(0), i * SIZE - OVERLAP))
    docs = docs.withColumn("counts", counts)
    start = H.chunked_header_bytes(F.size("counts"))
    return docs.withColumn("offsets", F.transform("counts", lambda _, i: start + i * SIZE + F.greatest(F.lit(0), i - 1) * OVERLAP))


OFFSETS = f"SELECT doc_id, chunk_id, n_tokens, (25 + 6 * count(*) OVER w + coalesce(sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS pos FROM ({CHUNKS.format(s=SIZE, o=OVERLAP)}) WINDOW w AS (PARTITION BY doc_id)"


@query(f"SELECT doc_id, chunk_id, pos FROM ({OFFSETS})")
def q_chunk_offsets(spark, sf_dir):
    return layout(spark, sf_dir).select("doc_id", F.posexplode("offsets").alias("chunk_id", "pos"))


def chunked_header():
    return H.pack_chunked_header(F.col("n"), F.col("n"), F.lit(12_818_277), F.lit(SIZE), F.lit(OVERLAP), F.col("offsets"), F.col("counts"))


@query(f"""SELECT doc_id, '4C4C4D50' || '01' || {LE('n', 4)} || {LE('n', 4)} || {LE('12818277', 4)} || {LE('k', 2)} || {LE(SIZE, 2)} || {LE(OVERLAP, 2)} || '0000' || coalesce(o, '') || coalesce(c, '') AS header FROM (
 SELECT doc_id, any_value(n) AS n, count(chunk_id) AS k, string_agg({LE('pos', 4)}, '' ORDER BY chunk_id) AS o, string_agg({LE('n_tokens', 2)}, '' ORDER BY chunk_id) AS c
 FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) LEFT JOIN ({OFFSETS}) USING (doc_id) GROUP BY doc_id)""")
def q_chunked_header_pack(spark, sf_dir):
    return layout(spark, sf_dir).select("doc_id", F.hex(chunked_header()).alias("header"))


@query(f"SELECT doc_id, chunk_id, pos::BIGINT AS pos, n_tokens::BIGINT AS n_tokens, 'ok' AS status FROM ({OFFSETS})")
def q_chunked_header_unpack(spark, sf_dir):
    h = layout(spark, sf_dir).select("doc_id", H.unpack_chunked_header(chunked_header()).alias("h"))
    return h.select("doc_id", "h.counts", "h.status", F.posexplode("h.offsets").alias("chunk_id", "pos")).select("doc_id", "chunk_id", "pos", F.get("counts", F.col("chunk_id")).alias("n_tokens"), "status")


@query(f"{CDF} SELECT sym, lo, hi, total FROM cdf")
def q_cdf(spark, sf_dir):
    return M.static_cdf(M.byte_symbols(docs_of(spark, sf_dir)))


@query(f"{CDF} SELECT v.range::INTEGER AS target, sym FROM range(0, 65000, 97) v JOIN cdf ON lo <= v.range AND v.range < hi")
def q_find_symbol(spark, sf_dir):
    model = P.train(docs_of(spark, sf_dir))
    ends = F.array(*map(F.lit, model.cdf[1:]))
    return spark.range(0, 65000, 97).select(F.col("id").cast("int").alias("target"), F.size(F.filter(ends, lambda e: e <= F.col("id"))).alias("sym"))


@query(f"{CDF} SELECT doc_id, sum(lo)::BIGINT AS sum_lo, sum(hi)::BIGINT AS sum_hi FROM s JOIN cdf USING (sym) GROUP BY doc_id")
def q_symbol_ranges(spark, sf_dir):
    symbols = M.byte_symbols(docs_of(spark, sf_dir), "text", "doc_id")
    cdf = M.static_cdf(symbols)
    per = symbols.groupBy("doc_id", "sym").count()
    return per.join(F.broadcast(cdf), "sym").groupBy("doc_id").agg(F.sum(F.col("lo") * F.col("count")).alias("sum_lo"), F.sum(F.col("hi") * F.col("count")).alias("sum_hi"))


@query(f"{CDF} SELECT doc_id, round(sum(log2(total / (hi - lo)::DOUBLE)), 2) AS bits FROM s JOIN cdf USING (sym) GROUP BY doc_id")
def q_code_length(spark, sf_dir):
    symbols = M.byte_symbols(docs_of(spark, sf_dir), "text", "doc_id")
    per = symbols.groupBy("doc_id", "sym").count().join(F.broadcast(M.static_cdf(symbols)), "sym")
    return per.groupBy("doc_id").agg(F.round(F.sum(F.col("count") * F.log2(F.col("total") / (F.col("hi") - F.col("lo")))), 2).alias("bits"))


@query(f"SELECT lang, round(-sum(n / al * log2(n / al)), 6) AS entropy FROM (SELECT lang, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY lang))::DOUBLE AS al FROM (SELECT lang, sym, count(*) AS n FROM ({SYMS}) GROUP BY lang, sym)) GROUP BY lang")
def q_entropy(spark, sf_dir):
    per = M.byte_symbols(docs_of(spark, sf_dir), "text", "lang").groupBy("lang", "sym").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    return per.withColumn("p", p).groupBy("lang").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query(f"SELECT prev::INTEGER AS prev, sym, count(*) AS n FROM (SELECT sym, lag(sym, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM ({SYMS})) GROUP BY ALL")
def q_context(spark, sf_dir):
    return M.contexts(docs_of(spark, sf_dir))


MOCK = """WITH g AS (SELECT p.range::INTEGER AS prev, s.range::INTEGER AS pos, i.range::INTEGER AS sym FROM range(8) p CROSS JOIN range(8) s CROSS JOIN range(320) i),
 b AS (SELECT *, (-ln(sym + 1.0::DOUBLE) + sin(sym * 0.1::DOUBLE + pos * 0.5::DOUBLE))::FLOAT AS base FROM g),
 l AS (SELECT prev, pos, sym, CASE WHEN (7 * prev + 13 * pos) % 320 = sym THEN (base::DOUBLE + 3)::FLOAT ELSE base END AS logit FROM b),
 m AS (SELECT *, max(logit) OVER (PARTITION BY prev, pos) AS top FROM l),
 e AS (SELECT *, exp(logit::DOUBLE - top::DOUBLE)::FLOAT AS e FROM m),
 p AS (SELECT *, (e::DOUBLE * (1 / sum(e::DOUBLE) OVER (PARTITION BY prev, pos)))::FLOAT AS p FROM e)"""


def mock(spark):
    return M.mock_logits(spark, 320, list(range(8)), 8)


@query(f"{MOCK} SELECT prev, pos, sym, round(p::DOUBLE, 5) AS p FROM p")
def q_softmax(spark, sf_dir):
    return M.softmax(mock(spark), "prev", "pos").select("prev", "pos", "sym", F.round(F.col("p").cast("double"), 5).alias("p"))


@query(f"{MOCK}, x AS (SELECT *, ln(sum(exp(logit::DOUBLE - top::DOUBLE)) OVER (PARTITION BY prev, pos)) AS z FROM m) SELECT prev, pos, sym, round((logit::DOUBLE - (top::DOUBLE + z))::FLOAT::DOUBLE, 4) AS logp FROM x")
def q_log_softmax(spark, sf_dir):
    return M.log_softmax(mock(spark), "prev", "pos").select("prev", "pos", "sym", F.round(F.col("logp").cast("double"), 4).alias("logp"))


@query(f"{MOCK}, q AS (SELECT *, greatest(1, floor(p::DOUBLE * 65536))::BIGINT AS n FROM p) SELECT prev, pos, sym, (sum(n) OVER w - n)::BIGINT AS lo, (sum(n) OVER w)::BIGINT AS hi, (sum(n) OVER (PARTITION BY prev, pos))::BIGINT AS total FROM q WINDOW w AS (PARTITION BY prev, pos ORDER BY sym)")
def q_mock_cdf(spark, sf_dir):
    return M.cumulative(M.softmax(mock(spark), "prev", "pos"), "prev", "pos")


@query(f"WITH q AS (SELECT range::INTEGER AS sym, greatest(1, floor((1.0::DOUBLE / (range + 1) / {sum(1.0 / (i + 1) for i in range(M.VOCABULARY))!r}::DOUBLE)::FLOAT::DOUBLE * 65536))::BIGINT AS n FROM range({M.VOCABULARY})) SELECT sym, (sum(n) OVER (ORDER BY sym) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY sym))::BIGINT AS hi, (sum(n) OVER ())::BIGINT AS total FROM q")
def q_zipf_cdf(spark, sf_dir):
    return M.cumulative(M.zipf(spark))


BITS = "lpad(bin(doc_id & 1023), 10, '0') || lpad(bin(n_chars & 8191), 13, '0')"


@query(f"SELECT doc_id, printf('%06X', ((doc_id & 1023) * 8192 + (n_chars & 8191)) * 2) AS packed FROM documents")
def q_bits_pack(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", B.pack_bits(F.concat(B.bits_of(F.col("doc_id"), 10), B.bits_of(F.col("n_chars"), 13))).alias("packed"))


@query("SELECT doc_id, (length(bin(doc_id)) + length(bin(n_chars)))::INTEGER AS n_bits, ceil((length(bin(doc_id)) + length(bin(n_chars))) / 8.0)::INTEGER AS n_bytes FROM documents")
def q_bit_count(spark, sf_dir):
    bits = F.concat(F.bin("doc_id"), F.bin("n_chars"))
    return docs_of(spark, sf_dir).select("doc_id", F.length(bits).alias("n_bits"), F.length(F.unhex(B.pack_bits(bits))).alias("n_bytes"))


@query("SELECT doc_id, doc_id & 1023 AS a, n_chars & 8191 AS b, 0::BIGINT AS past FROM documents")
def q_bits_unpack(spark, sf_dir):
    made = F.unhex(B.pack_bits(F.concat(B.bits_of(F.col("doc_id"), 10), B.bits_of(F.col("n_chars"), 13))))
    return docs_of(spark, sf_dir).select("doc_id", made.alias("d")).select("doc_id", B.read_bits(F.col("d"), F.lit(0), 10).alias("a"), B.read_bits(F.col("d"), F.lit(10), 13).alias("b"), B.read_bits(F.col("d"), F.lit(23), 32).alias("past"))


STATS = "n AS original_size, n AS token_count, (25 + octet_length(payload))::INTEGER AS compressed_size, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE n / (25 + octet_length(payload))::DOUBLE END AS ratio, CASE WHEN n > 0 THEN (8 * (25 + octet_length(payload))) / n::DOUBLE END AS bits_per_byte"


@query(f"{WHOLE} SELECT doc_id, {STATS}, md5(payload) AS payload_md5 FROM p")
def q_compress(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = P.statistics(P.compress(docs, P.train(docs)))
    return rows.withColumn("payload_md5", F.md5(H.split(F.col("data"))[1])).drop("data")


@query("SELECT doc_id, md5(text) AS digest, true AS ok FROM documents")
def q_roundtrip(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = P.train(docs)
    return P.decompress(P.compress(docs, model), model).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "ok")


@query("SELECT doc_id, md5(text) AS digest, true AS ok, md5(text) AS chunked_digest, true AS chunked_ok FROM documents")
def q_roundtrip_context(spark, sf_dir):
    """Both forms under counts by the byte before."""
    docs = docs_of(spark, sf_dir)
    model = P.train(docs, order=1)
    whole = P.decompress(P.compress(docs.withColumn("own", F.col("text")), model, keep=["own"]), model, keep=["own"])
    whole = whole.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("ok").alias("whole_ok"), "own")
    kept = ["digest", "whole_ok"]
    parts = P.decompress_chunked(P.compress_chunked(whole, model, SIZE, OVERLAP, text="own", keep=kept), model, keep=kept)
    return parts.select("doc_id", "digest", F.col("whole_ok").alias("ok"), F.md5(F.col("text").cast("binary")).alias("chunked_digest"), F.col("ok").alias("chunked_ok"))


@query("SELECT doc_id, md5(text) AS digest, true AS ok FROM documents")
def q_roundtrip_mock(spark, sf_dir):
    """Chunks under the stand-in for a neural model, whose counts depend on the symbol before and the position."""
    model = M.MockModel()
    return P.decompress_chunked(P.compress_chunked(docs_of(spark, sf_dir), model, SIZE, OVERLAP), model).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "ok")


@query(f"""{RANGES}, {CODED(SIZE, OVERLAP)}, z AS (SELECT doc_id, count(*) AS chunks, sum(octet_length(payload)) AS bytes, md5(unhex(string_agg(hex(payload), '' ORDER BY k))) AS payload_md5 FROM cp GROUP BY doc_id)
 SELECT doc_id, n AS original_size, coalesce(chunks, 0)::INTEGER AS chunk_count, (25 + 6 * coalesce(chunks, 0) + coalesce(bytes, 0))::INTEGER AS compressed_size, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE n / (25 + 6 * chunks + bytes)::DOUBLE END AS ratio,
 CASE WHEN n > 0 THEN (8 * (25 + 6 * chunks + bytes)) / n::DOUBLE END AS bits_per_byte, coalesce(payload_md5, md5('')) AS payload_md5 FROM b LEFT JOIN z USING (doc_id)""")
def q_compress_chunked(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = P.statistics(P.compress_chunked(docs, P.train(docs), SIZE, OVERLAP))
    payload = F.substring("data", F.col("chunk_count") * 6 + 26, F.length("data"))
    return rows.withColumn("payload_md5", F.md5(payload)).drop("data")


@query("SELECT doc_id, md5(text) AS digest, true AS ok FROM documents")
def q_roundtrip_chunked(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = P.train(docs)
    return P.decompress_chunked(P.compress_chunked(docs, model, SIZE, OVERLAP), model).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "ok")


@query(f"{RANGES}, {CODED(SIZE, OVERLAP)} SELECT doc_id, k::INTEGER AS chunk_id, len(t)::INTEGER AS n_tokens, least({OVERLAP}, k * {SIZE})::INTEGER AS skip, md5(payload) AS payload_md5 FROM cp")
def q_chunk_payloads(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = P.chunk_payloads(P.compress_chunked(docs, P.train(docs), SIZE, OVERLAP))
    return rows.select("doc_id", "chunk_id", F.col("n_tokens").cast("int").alias("n_tokens"), F.col("skip").cast("int").alias("skip"), F.md5("payload").alias("payload_md5"))


@query(f"{RANGES}, {CODED(SIZE, OVERLAP)} SELECT doc_id, k::INTEGER AS chunk_id, hex(payload) AS payload FROM cp")
def q_ac_encode(spark, sf_dir):
    """Chunks coded by the built-in fold."""
    docs = docs_of(spark, sf_dir)
    return P.coded_chunks(docs, P.train(docs), SIZE, OVERLAP).select("doc_id", "chunk_id", F.hex("payload").alias("payload"))


@query(f"SELECT doc_id, c.k::INTEGER AS chunk_id, md5(unhex(c.t)) AS digest FROM (SELECT doc_id, unnest(list_transform(range(ceil(n / {SIZE}.0)::BIGINT), lambda k: {{'k': k, 't': substr(h, 2 * greatest(0, k * {SIZE} - {OVERLAP}) + 1, 2 * (least(n, (k + 1) * {SIZE}) - greatest(0, k * {SIZE} - {OVERLAP})))}})) AS c FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n, hex(encode(text)) AS h FROM documents))")
def q_ac_decode(spark, sf_dir):
    """The symbols of each coded chunk, what it repeats of the one before included."""
    docs = docs_of(spark, sf_dir)
    model = P.train(docs)
    parts = P.chunk_payloads(P.compress_chunked(docs, model, SIZE, OVERLAP))
    return P.decoded_chunks(parts, model).select("doc_id", "chunk_id", F.md5("symbols").alias("digest"))


@query(f"{WHOLE} SELECT doc_id, {STATS} FROM p")
def q_stats(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return P.statistics(P.compress(docs, P.train(docs))).drop("data")


@query(f"{WHOLE} SELECT lang, source, count(*) AS n_docs, sum(n)::BIGINT AS original_size, sum(25 + octet_length(payload))::BIGINT AS compressed_size, (8 * sum(25 + octet_length(payload)))::BIGINT / sum(n)::BIGINT::DOUBLE AS bits_per_byte FROM p GROUP BY ROLLUP (lang, source)")
def q_stats_by_lang(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    per = P.statistics(P.compress(docs, P.train(docs), keep=["lang", "source"]))
    return per.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"), (8 * F.sum("compressed_size") / F.sum("original_size")).alias("bits_per_byte"))


RATIO = "CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE n / ({})::DOUBLE END"


@query(f"{WHOLE}, {CODED(SIZE, OVERLAP)}, z AS (SELECT doc_id, 25 + 6 * count(*) + sum(octet_length(payload)) AS size FROM cp GROUP BY doc_id), both_sizes AS (SELECT doc_id, {RATIO.format('25 + octet_length(payload)')} AS whole, {RATIO.format('size')} AS chunked FROM p LEFT JOIN z USING (doc_id)) SELECT doc_id, whole, chunked, (whole - chunked) / whole * 100 AS loss FROM both_sizes")
def q_ratio_loss(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = P.train(docs)
    whole = P.statistics(P.compress(docs, model, keep=["text"])).select("doc_id", "text", F.col("ratio").alias("whole"))
    parts = P.statistics(P.compress_chunked(whole, model, SIZE, OVERLAP, keep=["whole"])).select("doc_id", "whole", F.col("ratio").alias("chunked"))
    return parts.withColumn("loss", (F.col("whole") - F.col("chunked")) / F.col("whole") * 100)


SWEEP_SQL = " UNION ALL ".join(f"SELECT * FROM ({RANGES}, {CODED(s, o)} SELECT {s} AS chunk_size, {o} AS overlap_size, count(*) AS n_chunks, (sum(6 + octet_length(payload)) + (SELECT 25 * count(*) FROM b))::BIGINT AS compressed_size, (SELECT sum(n) FROM b)::BIGINT / (sum(6 + octet_length(payload)) + (SELECT 25 * count(*) FROM b))::BIGINT::DOUBLE AS ratio FROM cp)" for s, o in SWEEP)


@query(SWEEP_SQL)
def q_chunk_sweep_sizes(spark, sf_dir):
    """What each setting of chunks and overlap costs in bytes."""
    docs, out = docs_of(spark, sf_dir), None
    model = P.train(docs)
    for s, o in SWEEP:
        rows = P.compress_chunked(docs, model, s, o)
        one = rows.agg(F.sum("chunk_count").alias("n_chunks"), F.sum(F.length("data")).alias("compressed_size"), F.sum("original_size").alias("n"))
        one = one.select(F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap_size"), "n_chunks", "compressed_size", (F.col("n") / F.col("compressed_size")).alias("ratio"))
        out = one if out is None else out.union(one)
    return out


@query(f"{WHOLE}, h AS (SELECT -sum(n / al * log2(n / al)) AS h FROM (SELECT n::DOUBLE AS n, (sum(n) OVER ())::DOUBLE AS al FROM c)) SELECT round(any_value(h), 6) AS entropy, round(8 * sum(octet_length(payload)) / sum(n)::DOUBLE, 6) AS bits_per_symbol, 8 * sum(octet_length(payload)) / sum(n)::DOUBLE BETWEEN 0.9 * any_value(h) AND 1.2 * any_value(h) AS within FROM p CROSS JOIN h")
def q_entropy_bound(spark, sf_dir):
    """Bits that the coder gives out for a symbol, against the corpus's entropy: within 0.9 to 1.2 times."""
    docs = docs_of(spark, sf_dir)
    counts = M.byte_symbols(docs, "text").groupBy("sym").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy())
    h = counts.withColumn("p", p).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    rows = P.compress(docs, P.train(docs)).agg((8 * F.sum(F.length("data") - H.HEADER_BYTES) / F.sum("token_count")).alias("b"))
    both = rows.join(F.broadcast(h))
    return both.select(F.round("h", 6).alias("entropy"), F.round("b", 6).alias("bits_per_symbol"), F.col("b").between(0.9 * F.col("h"), 1.2 * F.col("h")).alias("within"))


@query(f"""WITH s AS (SELECT doc_id, sym, lag(sym, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM ({SYMS})), c AS (SELECT prev, sym, count(*) AS n FROM s GROUP BY ALL),
 g AS (SELECT *, greatest(1, floor((n / (sum(n) OVER (PARTITION BY prev))::DOUBLE)::FLOAT::DOUBLE * 65536))::BIGINT AS q, count(*) OVER (PARTITION BY prev) AS seen FROM c), t AS (SELECT prev, sym, q, (sum(q) OVER (PARTITION BY prev) + 256 - seen)::BIGINT AS total FROM g)
 SELECT doc_id, round(sum(log2(total / q::DOUBLE)), 2) AS bits FROM s JOIN t USING (prev, sym) GROUP BY doc_id""")
def q_code_length_context(spark, sf_dir):
    """The code length of each text under counts by the byte before."""
    docs = docs_of(spark, sf_dir)
    table = M.bigram_cdf(M.contexts(docs)).select("prev", "sym", F.log2(F.col("total") / (F.col("hi") - F.col("lo"))).alias("b"))
    per = M.pair_counts(docs, "text", "doc_id").join(F.broadcast(table), ["prev", "sym"])
    return per.groupBy("doc_id").agg(F.round(F.sum(F.col("n") * F.col("b")), 2).alias("bits"))


@query()
def q_gzip_compare(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    whole = P.compress(docs, P.train(docs), keep=["text"]).select("doc_id", "text", "original_size", F.length("data").alias("compressed_size"))
    return P.gzip_sizes(whole, keep=["original_size", "compressed_size"])


@query("SELECT doc_id, CASE WHEN length(text) > 10 THEN 10::BIGINT END AS pos FROM documents")
def q_first_diff(spark, sf_dir):
    """Texts against themselves with another eleventh character; shorter ones are equal."""
    changed = F.when(F.length("text") > 10, F.concat(F.substring("text", 1, 10), F.lit("\x07"), F.expr("substring(text, 12)"))).otherwise(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", P.first_difference(F.col("text"), changed).alias("pos"))

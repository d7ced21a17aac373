"""Compression of text columns, as one stream for each text or as independent chunks, and its statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import latin
from ..operators import chunks as C
from ..operators.coder import coded
from ..operators.models import Model, train
from ..sources import containers as H

__all__ = ["Model", "train"]
#: Symbols that are coded together, about; a longer text is coded by itself.
BATCH = 1 << 21


def intervals(model: Model) -> Column:
    """array<struct<lo, hi, total>> by symbol of a model of one context, as a constant."""
    c = model.cdf
    return F.array(*(F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi"), F.lit(c[-1]).cast("long").alias("total")) for a, b in zip(c, c[1:])))


def together(sizes: list[int]):
    """Slices of neighbours of about BATCH symbols."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def mapped(rows: DataFrame, given: dict[str, Column], key: str, keep: Sequence[str], out: str, work) -> DataFrame:
    """key, the kept columns and those of `out`: work(lists of the given columns) for slices of each Arrow batch. No row moves."""
    names = [f"k{i}" for i in range(1 + len(keep))]
    own = rows.select(*(F.col(c).alias(n) for c, n in zip((key, *keep), names)), *(c.alias(n) for n, c in given.items()))
    kept = T.StructType([own.schema[n] for n in names])
    made = T.StructType.fromDDL(out)
    inputs = list(given)

    def run(batches):
        for b in batches:
            cols = [b.column(n).to_pylist() for n in inputs]
            for part in together([len(x) if isinstance(x, (str, bytes)) else 0 for x in cols[0]]):
                results = work(*(c[part] for c in cols))
                whole = b.slice(part.start, part.stop - part.start)
                types = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() if isinstance(f.dataType, T.StringType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64() for f in made]
                yield pa.RecordBatch.from_arrays([whole.column(n) for n in names] + [pa.array(x, t) for x, t in zip(results, types, strict=True)], names + [f.name for f in made])

    got = own.mapInArrow(run, T.StructType(kept.fields + made.fields))
    return got.select(*(F.col(n).alias(c) for c, n in zip((key, *keep), names)), *(f.name for f in made))


def symbols(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def byte_tokens(text: Column) -> Column:
    return F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(latin(text), ""), lambda c: F.ascii(c)))


def statistics(rows: DataFrame) -> DataFrame:
    """Adds compressed_size, ratio (1 for empty texts) and bits_per_byte to rows with data and original_size."""
    size, n = F.length("data"), F.col("original_size")
    return rows.withColumns({"compressed_size": size, "ratio": F.when(n == 0, F.lit(1.0)).otherwise(n / size), "bits_per_byte": F.when(n > 0, 8 * size / n)})


def compress(docs: DataFrame, model, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """key, the kept columns, original_size, token_count and data (an LLMC container). A null text gives nulls; an empty one only a header."""

    def work(texts):
        return ([None if t is None else p for t, p in zip(texts, model.encode([symbols(t) for t in texts]), strict=True)],)

    n = F.octet_length(text).cast("long")
    rows = mapped(docs.select("*", n.alias("_n")), {"t": F.col(text).cast("string")}, key, (*keep, "_n"), "payload binary", work)
    data = F.concat(H.pack_header(F.col("_n"), F.col("_n"), F.lit(model.hash)), "payload")
    return rows.select(key, *keep, F.col("_n").alias("original_size"), F.col("_n").alias("token_count"), data.alias("data"))


def checked(head: Column, model) -> Column:
    """A container's fields; one that isn't valid raises with what is wrong, and so does one of another model."""
    other = F.raise_error(F.lit("the data was made with another model"))
    return F.when(head["status"] != "ok", F.raise_error(head["status"])).when(head["model_hash"] != model.hash, other).otherwise(head)


def decompress(rows: DataFrame, model, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """key, the kept columns, text and ok (the text has the size that the header says).

    A null container gives a null text. One that is too short, of another format or version, or of another model, raises.
    """

    def work(payloads, counts):
        found = model.decode([p or b"" for p in payloads], [n or 0 for n in counts])
        return ([None if n is None else bytes(x.astype(np.uint8)).decode(errors="replace") for n, x in zip(counts, found, strict=True)],)

    head, payload = H.split(F.col("data"))
    parsed = rows.select("*", F.when(F.col("data").isNotNull(), H.once(H.unpack_header(head), lambda h: checked(h, model))).alias("_h"))
    got = mapped(parsed.select("*", F.col("_h.original_length").alias("_size")), {"p": payload, "n": F.col("_h.token_count")}, key, (*keep, "_size"), "text string", work)
    return got.select(key, *keep, "text", (F.octet_length("text") == F.col("_size")).alias("ok"))


def coded_chunks(docs: DataFrame, model: Model, size: int = 128, overlap: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_id, tokens, output_start, output_count and payload: each chunk coded on its own by built-in expressions."""
    # chunks are dealt out before the costly fold, or one long text would be one task's work
    rows = C.exploded(docs, byte_tokens(F.col(text)), size, overlap, key).repartition(key, "chunk_id")
    with_model = rows.withColumn("ranges", intervals(model))
    return with_model.withColumn("payload", coded(F.transform("tokens", lambda t: F.get(F.col("ranges"), t)))).drop("ranges")


def compress_chunked(docs: DataFrame, model, size: int = 128, overlap: int = 16, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """key, the kept columns, original_size, chunk_count and data (an LLMP container).

    Each row is coded by itself, its chunks in lockstep, so neither null nor repeated keys matter. A null text gives nulls
    and an empty one a 25-byte header. A text of more than 65,535 chunks raises before it is coded.
    """
    C.validate(size, overlap)
    own = model.hash

    def work(texts):
        streams, counts = [], []
        for t in texts:
            s = symbols(t)
            counts.append(-(-len(s) // size))
            streams += [s[max(0, k * size - overlap) : (k + 1) * size] for k in range(counts[-1])]
        coded_streams, at, data = model.encode(streams), 0, []
        for t, n in zip(texts, counts, strict=True):
            parts, sizes = coded_streams[at : at + n], [len(x) for x in streams[at : at + n]]
            data.append(None if t is None else H.chunked_container(len(t.encode()), sum(min(size, len(t.encode()) - k * size) for k in range(n)), own, size, overlap, sizes, parts))
            at += n
        return data, [None if t is None else n for t, n in zip(texts, counts, strict=True)]

    n = F.octet_length(text).cast("long")
    chunks = F.ceil(n / size)
    checked_text = F.when(chunks > 65_535, F.raise_error(F.lit("more than 65,535 chunks"))).otherwise(F.col(text).cast("string"))
    rows = mapped(docs.select("*", n.alias("_n")), {"t": checked_text}, key, (*keep, "_n"), "data binary, chunk_count long", work)
    return rows.select(key, *keep, F.col("_n").alias("original_size"), F.col("chunk_count").cast("int").alias("chunk_count"), "data")


def chunk_payloads(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_id, n_tokens, skip (tokens that repeat the chunk before) and payload of every chunk of LLMP containers."""
    head = rows.select(key, "data", H.unpack_chunked_header(F.col("data")).alias("h"))
    each = head.select(key, "data", "h.*").filter("chunk_count > 0").withColumn("z", F.concat(F.slice("offsets", 2, F.size("offsets")), F.array(F.length("data").cast("long"))))
    each = each.select(key, "data", "counts", "chunk_size", "overlap_size", "z", F.posexplode("offsets").alias("chunk_id", "at"))
    end = F.get(F.col("z"), F.col("chunk_id"))
    skip = F.least(F.col("overlap_size"), F.col("chunk_id") * F.col("chunk_size"))
    return each.select(key, "chunk_id", F.get("counts", F.col("chunk_id")).alias("n_tokens"), skip.alias("skip"), F.substring("data", (F.col("at") + 1).cast("int"), (end - F.col("at")).cast("int")).alias("payload"))


def decoded_chunks(parts: DataFrame, model, key: str = "doc_id") -> DataFrame:
    """key, chunk_id and symbols (a byte for each) of the rows that `chunk_payloads` gives."""

    def work(payloads, counts):
        return ([x.astype(np.uint8).tobytes() for x in model.decode(payloads, counts)],)

    return mapped(parts, {"p": F.col("payload"), "n": F.col("n_tokens").cast("long")}, key, ["chunk_id"], "symbols binary", work)


def decompress_chunked(rows: DataFrame, model, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """key, the kept columns, text and ok: chunks are decoded each on its own, then joined in order without what they repeat.

    A null container gives a null text. One that is too short, of another format or version, of another model, or with
    offsets that don't ascend within it, raises.
    """
    own = model.hash

    def work(containers):
        heads = [None if d is None else H.parse_chunked(d, own) for d in containers]
        payloads = [d[a:z] for d, h in zip(containers, heads, strict=True) if h for a, z in zip(h.offsets, [*h.offsets[1:], len(d)])]
        counts = [n for h in heads if h for n in h.counts]
        found, at, texts, good = model.decode(payloads, counts), 0, [], []
        for h in heads:
            if h is None:
                texts.append(None)
                good.append(None)
                continue
            parts = found[at : at + len(h.counts)]
            at += len(h.counts)
            whole = b"".join(x[min(h.overlap, k * h.size) :].astype(np.uint8).tobytes() for k, x in enumerate(parts))
            texts.append(whole.decode(errors="replace"))
            good.append(len(whole) == h.length)
        return texts, good

    return mapped(rows, {"d": F.col("data")}, key, keep, "text string, ok boolean", work)


def first_difference(a: Column, b: Column) -> Column:
    """0-based position of the first character in which two texts differ; null if they are equal."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when(a.eqNullSafe(b), F.lit(None)).otherwise(F.array_position(pairs, F.lit(True)) - 1)


def gzip_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """key, the kept columns and gzip_size, the bytes that gzip takes; null for null."""

    def work(texts):
        import gzip

        return ([None if t is None else len(gzip.compress(t.encode(), mtime=0)) for t in texts],)

    return mapped(docs, {"t": F.col(text).cast("string")}, key, keep, "gzip_size long", work)

"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, if there is one; every later frame
is a whole record compressed with it. A record is checked on reading: its version line, the headers that it must have,
Content-Length against the block, and a response's digest and length against its payload. A page whose payload an earlier
page has too becomes a revisit, which names that page and holds no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, open_store, publish

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
LEAST_BYTES = 100
DICT_BYTES, DICT_PAGES, DICT_PAGE_BYTES = 64 << 10, 400, 8 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadArchive(ValueError):
    """An archive that isn't as the format says."""


def record_id(page_id: int | None, digest: str) -> str:
    """A record's name, which a revisit can tell of the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    block = HTTP + payload if kind == "response" else HTTP
    clean = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "urn:none")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": clean,
        "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Payload-Length": len(payload), "X-Page-Id": "" if page_id is None else page_id,
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": refers_to}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, checked."""
    top, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if not gap or first not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("not a WARC record")
    head = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if not colon or not k or k != k.strip():
            raise BadArchive(f"not a header: {line[:80]!r}")
        head[k.lower()] = v.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys():
        raise BadArchive(f"headers are missing: {sorted(missing)}")
    if not head["content-length"].isdigit() or len(rest) != (n := int(head["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("Content-Length doesn't fit the block")
    block = rest[:n]
    if (d := head.get("warc-block-digest")) and d != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadArchive("the block has another digest")
    return head, block


def frames(stream, chunk: int = 1 << 20, most: int = 1 << 31):
    """The records of an archive: first the leading skippable frame's dictionary is loaded, then each frame decoded. One of over
    `most` bytes is refused before it takes more memory."""
    import zstandard as zstd

    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<II", data)[0] == SKIPPABLE:
        size = struct.unpack("<II", data)[1]
        raw = stream.read(size)
        if len(raw) != size:
            raise BadArchive("cut off in the dictionary")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
        dictionary, data = zstd.ZstdCompressionDict(raw), b""
    unpack = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    while True:
        if not data and not (data := stream.read(chunk)):
            return
        one, parts, size = unpack.decompressobj(read_across_frames=False), [], 0
        while True:
            try:
                parts.append(one.decompress(data))
            except zstd.ZstdError as e:
                raise BadArchive(f"a frame can't be decoded: {e}") from e
            size += len(parts[-1])
            if size > most:
                raise BadArchive(f"a frame of over {most} bytes")
            if one.eof:
                data = one.unused_data
                break
            if not (data := stream.read(chunk)):
                raise BadArchive("cut off in a frame")
        yield b"".join(parts)


def read_page(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record."""
    head, block = parse(data)
    kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
    payload = block.partition(b"\r\n\r\n")[2]
    size = int(head["x-payload-length"])
    if kind == "response" and (size != len(payload) or digest != hashlib.sha256(payload).hexdigest()):
        raise BadArchive("a payload has another length or digest")
    number = lambda k: int(v) if (v := head.get(k)) else None
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page")


def train(pages: DataFrame, size: int = DICT_BYTES) -> bytes:
    """A dictionary from at most DICT_PAGES pages, of each at most DICT_PAGE_BYTES; b"" if they are too few."""
    import zstandard as zstd

    some = pages.filter("length(html) > 0").select(F.substring("html", 1, DICT_PAGE_BYTES).alias("t")).limit(DICT_PAGES).collect()
    try:
        return zstd.train_dictionary(size, [HTTP + r.t.encode() for r in some]).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b""


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses).

    The pages of one digest are summed up to the least page_id before any join, and only digests that occur twice join
    the pages, so a payload that a third of all pages hold costs one row. Of pages that share the least page_id too, and
    of pages without page_id, all are responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = own.filter(F.octet_length("html") >= LEAST_BYTES)
    first = cut(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    refers = F.when((F.octet_length("html") >= LEAST_BYTES) & (F.col("first") < F.col("page_id")), F.col("first"))
    return own.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, out: str, dictionary: bytes = b"", level: int = 3) -> list:
    """Writes an archive for each partition under the URI out, by a draft that is renamed when complete. Returns (path, records) of each."""

    def run(batches):
        import zstandard as zstd
        from pyspark import TaskContext

        task, (fs, base), n = TaskContext.get(), open_store(out), 0
        fs.create_dir(base, recursive=True)
        path = f"{base}/part-{task.partitionId():06d}.warc.zst"
        draft = f"{path}.{task.taskAttemptId()}"
        packer = zstd.ZstdCompressor(level=level, write_checksum=True, dict_data=zstd.ZstdCompressionDict(dictionary)) if dictionary else zstd.ZstdCompressor(level=level, write_checksum=True)
        with fs.open_output_stream(draft, compression=None) as f:
            if dictionary:
                body = zstd.ZstdCompressor(level=9).compress(dictionary)
                f.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
            for b in batches:
                for i, url, html, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    f.write(packer.compress(record(i, url, "response" if refers is None else "revisit", html.encode(), digest, refers)))
                    n += 1
        if n:
            publish(fs, draft, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})
        else:
            fs.delete_file(draft)

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, n long").collect()


def read_archives(spark: SparkSession, files: list, out: str) -> DataFrame:
    """The checked records of archives: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    if not files:
        return spark.createDataFrame([], OUT)

    def run(batches):
        fs, _ = open_store(out)
        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                    rows = [read_page(x) for x in frames(f)]
                if len(rows) != n:
                    raise BadArchive(f"{path}: {len(rows)} records, {n} were written")
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return spark.createDataFrame([(r.path, r.n) for r in files], "path string, n long").repartition(len(files)).mapInArrow(run, OUT)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes every page as a WARC record (null html: empty payload) in the shared folder and reads the archives back."""
    out = fresh_dir(spark, "warc")
    return read_archives(spark, write_archives(deduplicated(pages), out, train(pages)), out)

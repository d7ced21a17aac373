"""Token sequences in length-delimited binary records with masked checksums and an offset index.

A shard is a data file and an index file. The data file starts with MAGIC, the id width (u8) and 7 zero bytes. A record is

    length u64 | masked crc32 of those 8 bytes u32 | payload | masked crc32 of the payload u32

and its payload is a flag (u8, 1 if doc_id is given), doc_id (i64) and the ids, all little-endian. The index has one entry
(flag u8, doc_id i64, byte offset u64, tokens u64) for each record, then a masked crc32 of all entries; it lets a reader
fetch records in any order. Shards hold ascending ranges of doc_id, so shard order and record order give the corpus order.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, open_store, publish
from .encode import encoder

MAGIC = b"BREVTOK1"
HEAD, CRC, LEAD, ENTRY = "<QI", "<I", "<Bq", "<BqQQ"
HEAD_SIZE, CRC_SIZE, LEAD_SIZE, ENTRY_SIZE = map(struct.calcsize, (HEAD, CRC, LEAD, ENTRY))
MANIFEST = "shard int, n_docs long, n_tokens long, data string, offsets string"


class CorruptRecord(ValueError):
    """A record or an index whose lengths or checksums don't fit."""


def masked(data: bytes) -> int:
    """crc32, rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums stays useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(CRC, masked(length)), payload, struct.pack(CRC, masked(payload))))


def unframe(stream, most: int = 1 << 40):
    """The payload at the stream's position, or None at its end."""
    head = stream.read(HEAD_SIZE)
    if not head:
        return None
    if len(head) < HEAD_SIZE:
        raise CorruptRecord("cut off in a record's length")
    length, crc = struct.unpack(HEAD, head)
    if crc != masked(head[:8]) or length > most:
        raise CorruptRecord("a record's length has a wrong checksum")
    payload, tail = stream.read(length), stream.read(CRC_SIZE)
    if len(payload) < length or len(tail) < CRC_SIZE:
        raise CorruptRecord("cut off in a record")
    if struct.unpack(CRC, tail)[0] != masked(payload):
        raise CorruptRecord("a record has a wrong checksum")
    return payload


def write_shards(docs: DataFrame, out: str, vocabulary: str, end_id: int = 1, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> list:
    """Encodes every whole text (null: empty), appends end_id and writes shards under the URI out, in ascending doc_id order.

    Rows are dealt by ranges of doc_id (null first) and sorted within. Rows with equal doc_id are dealt on by a hash of their
    texts, and equal rows by their place, so that no id or row is one task's work however often it occurs. Each task writes to names of its own attempt and renames both files when they are complete, so a repeated or
    speculative attempt leaves one whole shard. Returns the manifest: a row for each shard, in shard order.
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, code = task.partitionId(), encoder(vocabulary, width)
        fs, base = open_store(out)
        fs.create_dir(base, recursive=True)
        names = [f"{base}/shard-{shard:06d}.{x}" for x in ("bin", "idx")]
        drafts = [f"{x}.{task.taskAttemptId()}.part" for x in names]
        entries, tokens, at, end = [], 0, 16, code.pack([end_id])
        with fs.open_output_stream(drafts[0], compression=None) as data:
            data.write(MAGIC + bytes([width]) + bytes(7))
            for batch in batches:
                parts = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = code.encode(t) + end
                    record = frame(struct.pack(LEAD, i is not None, i or 0) + ids)
                    entries.append(struct.pack(ENTRY, i is not None, i or 0, at, len(ids) // width))
                    at, tokens = at + len(record), tokens + len(ids) // width
                    parts.append(record)
                data.write(b"".join(parts))
        if entries:
            body = b"".join(entries)
            with fs.open_output_stream(drafts[1], compression=None) as index:
                index.write(body + struct.pack(CRC, masked(body)))
            for a, b in zip(drafts, names, strict=True):
                publish(fs, a, b)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(entries)], "n_tokens": [tokens], "data": [names[0]], "offsets": [names[1]]})
        else:
            fs.delete_file(drafts[0])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", "h", "m"]
    ranged = rows.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST).collect(), key=lambda x: x.shard)


def read_index(fs, path: str) -> list[tuple]:
    """(doc_id or None, byte offset, tokens) of each record of a shard."""
    with fs.open_input_stream(path, compression=None) as f:
        body = f.read()
    if len(body) < 4 or (len(body) - 4) % ENTRY_SIZE or struct.unpack(CRC, body[-4:])[0] != masked(body[:-4]):
        raise CorruptRecord(f"{path}: the index has a wrong length or checksum")
    return [(i if given else None, at, n) for given, i, at, n in struct.iter_unpack(ENTRY, body[:-4])]


def read_record(fs, path: str, at: int) -> tuple:
    """(doc_id or None, packed ids) of the record at a byte offset from the index: a random read."""
    with fs.open_input_file(path) as f:
        f.seek(at)
        payload = unframe(f)
    given, i = struct.unpack_from(LEAD, payload)
    return (i if given else None), payload[LEAD_SIZE :]


def read_shards(spark: SparkSession, manifest: list, out: str) -> DataFrame:
    """Reads shards back, checking every length and checksum against the index: doc_id, start, n_tokens, ids_crc32.

    start: ids of all documents before, in shard and record order. The manifest has a row for each shard, not each document.
    """
    import numpy as np

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    starts, total = [], 0
    for m in manifest:
        starts.append((m.data, m.offsets, total, m.n_docs))
        total += m.n_tokens

    def run(batches):
        fs, _ = open_store(out)
        for batch in batches:
            for data, index, start, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                entries, rows = read_index(fs, index), ([], [], [], [])
                if len(entries) != n:
                    raise CorruptRecord(f"{index}: {len(entries)} entries, {n} expected")
                with fs.open_input_stream(data, compression=None, buffer_size=1 << 20) as f:
                    lead = f.read(16)
                    if lead[:8] != MAGIC:
                        raise CorruptRecord(f"{data}: not a token shard")
                    ids = np.dtype(f"<u{lead[8]}")
                    for i, _, count in entries:
                        payload = unframe(f)
                        given, j = struct.unpack_from(LEAD, payload or bytes(LEAD_SIZE))
                        got = np.frombuffer(payload or b"", ids, offset=LEAD_SIZE)
                        if (j if given else None) != i or len(got) != count:
                            raise CorruptRecord(f"{data}: a record isn't the one that the index names")
                        for k, v in zip(rows, (i, start, count, zlib.crc32(got.astype("<u4").tobytes())), strict=True):
                            k.append(v)
                        start += count
                    if f.read(1):
                        raise CorruptRecord(f"{data}: bytes after the last record")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(starts, "data string, index string, start long, n long").repartition(len(starts))
    return files.mapInArrow(run, schema)


def token_records(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1, width: int = 2) -> DataFrame:
    """Writes the documents as token shards in the shared folder and reads them back."""
    out = fresh_dir(spark, "token-records")
    return read_shards(spark, write_shards(docs, out, vocabulary, end_id, width), out)

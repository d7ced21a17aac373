"""The two binary containers as column expressions: LLMC (one stream) and LLMP (independent chunks). All fields are little-endian."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import le_hex, le_number

# Fixed values of the formats.
MAGIC, CHUNKED_MAGIC, VERSION, HEADER_BYTES, ENTRY_BYTES = "LLMC", "LLMP", 1, 25, 6


def pack_header(length: Column, tokens: Column, model: Column) -> Column:
    """25 bytes: magic, version u8, text bytes u32, tokens u32, model u32, 8 zero bytes. Values beyond u32 raise."""
    big = (length >= 1 << 32) | (tokens >= 1 << 32) | (model >= 1 << 32)
    whole = F.concat(F.hex(F.lit(MAGIC)), F.lit(f"{VERSION:02X}"), le_hex(length, 4), le_hex(tokens, 4), le_hex(model, 4), F.lit("00" * 8))
    return F.unhex(F.when(big, F.raise_error(F.lit("a header field exceeds 32 bits"))).otherwise(whole))


def status(data: Column, magic: str = MAGIC) -> Column:
    """'ok', or the first check that fails: too short, other magic, later version."""
    kind = "chunked " if magic == CHUNKED_MAGIC else ""
    return (
        F.when(F.length(data) < HEADER_BYTES, f"Invalid {kind}header")
        .when(F.hex(F.substring(data, 1, 4)) != magic.encode().hex().upper(), "not a chunked compressed file" if kind else "Invalid file format")
        .when(le_number(data, 4, 1) > VERSION, f"Unsupported {kind}format version")
        .otherwise("ok")
    )


def once(data: Column, body) -> Column:
    """body(data), with data computed once."""
    return F.transform(F.array(data), body)[0]


def unpack_header(data: Column) -> Column:
    """A struct of the fields; null fields where the status isn't 'ok'."""
    return once(data, _header_fields)


def _header_fields(data: Column) -> Column:
    good = status(data) == "ok"
    fields = {"version": (4, 1), "original_length": (5, 4), "token_count": (9, 4), "model_hash": (13, 4)}
    return F.struct(status(data).alias("status"), *(F.when(good, le_number(data, a, n)).alias(k) for k, (a, n) in fields.items()))


def split(data: Column) -> tuple[Column, Column]:
    """Header and payload of a sequential container."""
    return F.substring(data, 1, HEADER_BYTES), F.substring(data, F.lit(HEADER_BYTES + 1), F.length(data))


def chunked_header_bytes(chunks: Column) -> Column:
    return HEADER_BYTES + ENTRY_BYTES * chunks


def pack_chunked_header(length: Column, tokens: Column, model: Column, size: Column, overlap: Column, offsets: Column, counts: Column) -> Column:
    """Magic, version, three u32, chunk count, size and overlap u16, two zero bytes, then u32 offsets and u16 token counts. More than 65,535 chunks raise."""
    n = F.size(offsets)
    each = lambda a, w: F.array_join(F.transform(a, lambda x: le_hex(x, w)), "")
    whole = F.concat(F.hex(F.lit(CHUNKED_MAGIC)), F.lit(f"{VERSION:02X}"), le_hex(length, 4), le_hex(tokens, 4), le_hex(model, 4), le_hex(n, 2), le_hex(size, 2), le_hex(overlap, 2), F.lit("0000"), each(offsets, 4), each(counts, 2))
    big = (length >= 1 << 32) | (tokens >= 1 << 32) | (model >= 1 << 32) | (F.coalesce(F.array_max(offsets), F.lit(0)) >= 1 << 32)
    small = (size >= 1 << 16) | (overlap >= 1 << 16) | (F.coalesce(F.array_max(counts), F.lit(0)) >= 1 << 16)
    return F.unhex(F.when(n > 65_535, F.raise_error(F.lit("more than 65,535 chunks"))).when(big, F.raise_error(F.lit("a header field exceeds 32 bits"))).when(small, F.raise_error(F.lit("a header field exceeds 16 bits"))).otherwise(whole))


def unpack_chunked_header(data: Column) -> Column:
    """A struct of the fields, offsets and counts; null fields where the status isn't 'ok'."""
    return once(data, _chunked_fields)


def _chunked_fields(data: Column) -> Column:
    good, n = status(data, CHUNKED_MAGIC) == "ok", le_number(data, 17, 2)
    fields = {"original_length": (5, 4), "token_count": (9, 4), "model_hash": (13, 4), "chunk_count": (17, 2), "chunk_size": (19, 2), "overlap_size": (21, 2)}
    index = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    arrays = {"offsets": F.transform(index, lambda i: le_number(data, 25 + 4 * i, 4)), "counts": F.transform(index, lambda i: le_number(data, (25 + 4 * n + 2 * i).cast("int"), 2))}
    return F.struct(status(data, CHUNKED_MAGIC).alias("status"), *(F.when(good, le_number(data, a, w)).alias(k) for k, (a, w) in fields.items()), *(F.when(good, v).alias(k) for k, v in arrays.items()))


def is_chunked(data: Column) -> Column:
    return (F.length(data) >= 4) & (F.hex(F.substring(data, 1, 4)) == CHUNKED_MAGIC.encode().hex().upper())


@dataclass
class Chunked:
    """What a chunked container's header says."""

    length: int
    tokens: int
    size: int
    overlap: int
    offsets: list[int]
    counts: list[int]


FIELDS = "<4sBIIIHHH2x"


def chunked_container(length: int, tokens: int, model: int, size: int, overlap: int, counts: list[int], payloads: list[bytes]) -> bytes:
    """A whole chunked container. Fields that don't fit raise."""
    n = len(payloads)
    if n > 65_535:
        raise ValueError("more than 65,535 chunks")
    offsets, at = [], HEADER_BYTES + ENTRY_BYTES * n
    for p in payloads:
        offsets.append(at)
        at += len(p)
    if max(length, tokens, at) >= 1 << 32:
        raise ValueError("a header field exceeds 32 bits")
    return b"".join([struct.pack(FIELDS, CHUNKED_MAGIC.encode(), VERSION, length, tokens, model, n, size, overlap), struct.pack(f"<{n}I{n}H", *offsets, *counts), *payloads])


def parse_chunked(data: bytes, model: int) -> Chunked:
    """The header of a chunked container, checked."""
    if len(data) < HEADER_BYTES:
        raise ValueError("Invalid chunked header")
    magic, version, length, tokens, own, n, size, overlap = struct.unpack_from(FIELDS, data)
    if magic != CHUNKED_MAGIC.encode():
        raise ValueError("not a chunked compressed file")
    if version > VERSION:
        raise ValueError("Unsupported chunked format version")
    if own != model:
        raise ValueError("the data was made with another model")
    first = HEADER_BYTES + ENTRY_BYTES * n
    if len(data) < first:
        raise ValueError("Invalid chunked header")
    values = struct.unpack_from(f"<{n}I{n}H", data, HEADER_BYTES)
    offsets, counts = list(values[:n]), list(values[n:])
    if any(a > z for a, z in zip([first, *offsets], [*offsets, len(data)])):
        raise ValueError("Invalid chunked header: offsets don't ascend within the data")
    return Chunked(length, tokens, size, overlap, offsets, counts)

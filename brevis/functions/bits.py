"""Little-endian fields, bit strings and the byte alphabet as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the other 68 bytes take U+0100 and up, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, after = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else after))
        after += b not in own
    return out


def le_hex(value: Column, width: int) -> Column:
    """An unsigned integer as 2 * width hex digits, least byte first."""
    full = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.concat(*(F.substring(full, 2 * k + 1, 2) for k in reversed(range(width))))


def le_number(data: Column, at: int | Column, width: int) -> Column:
    """The unsigned integer of `width` bytes at 0-based offset `at` of a binary column."""
    where = at if isinstance(at, Column) else F.lit(at)
    parts = [F.conv(F.hex(F.substring(data, where + 1 + k, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(width)]
    return sum(parts[1:], parts[0])


def bits_of(value: Column, n: int) -> Column:
    """The n low bits of an integer, highest first, as a string of 0 and 1."""
    return F.lpad(F.bin(value.bitwiseAND(F.lit((1 << n) - 1)).cast("long")), n, "0")


def pack_bits(bits: Column) -> Column:
    """A bit string as bytes in hex: highest bit first, the last byte filled with zeros."""
    full = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    groups = F.sequence(F.lit(0), (F.length(full) / 8).cast("int") - 1)
    each = F.transform(groups, lambda g: F.lpad(F.conv(F.substring(full, g * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(F.length(bits) == 0, F.lit("")).otherwise(F.array_join(each, ""))


def read_bits(data: Column, at: Column, n: int) -> Column:
    """The unsigned integer of n bits (up to 56) from bit `at` of a binary column on; bits past its end are zero."""
    part = F.rpad(F.hex(F.substring(data, F.floor(at / 8).cast("int") + 1, F.lit(8))), 16, "0")
    bits = F.lpad(F.conv(part, 16, 2), 64, "0")
    return F.conv(F.substring(bits, (at % 8 + 1).cast("int"), F.lit(n)), 2, 10).cast("long")


def latin(text: Column) -> Column:
    """One character for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def encode_bytes(text: Column) -> Column:
    """UTF-8 bytes as characters of the byte alphabet; null stays null."""
    moved = [(b, c) for b, c in enumerate(byte_alphabet()) if chr(b) != c]
    return F.translate(latin(text), "".join(chr(b) for b, _ in moved), "".join(c for _, c in moved))


def decode_bytes(chars: Column) -> Column:
    """The text of characters of the byte alphabet: others are dropped and malformed UTF-8 becomes U+FFFD. A leading BOM is kept."""
    alphabet = byte_alphabet()
    moved = [(b, c) for b, c in enumerate(alphabet) if chr(b) != c and b]
    known = F.regexp_replace(chars, "[^" + "".join("\\" + c if c in "[]\\^-&" else c for c in alphabet) + "]+", "")
    plain = F.translate(known, "".join(c for _, c in moved), "".join(chr(b) for b, _ in moved))
    raw = F.encode(F.replace(plain, F.lit(alphabet[0]), F.lit("\0")), "ISO-8859-1")
    return F.make_valid_utf8(raw.cast("string"))

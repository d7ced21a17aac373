"""Arithmetic coding with 32-bit intervals.

`fold` codes a short array of intervals as one built-in expression: the renormalisation is closed-form (leading equal bits
go out at once, then a run of straddling bits is counted), so it fits a lambda. `Encoder` and `Decoder` are its twins for one
stream. `encode_lanes` and `decode_lanes` take many streams through the same steps in lockstep, as arrays; where only a few
long streams are left, those go on one by one.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import pack_bits

FULL, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def fold(ranges: Column) -> Column:
    """The bit string of array<struct<lo, hi, total>>, flushed but not yet filled to bytes."""
    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(FULL).alias("high"), F.lit(0).alias("pending"), F.lit("").alias("bits"))

    def step(s: Column, r: Column) -> Column:
        def narrowed(v: Column) -> Column:
            same = F.lit(32) - F.when(v["low"] == v["high"], 0).otherwise(F.length(F.bin(v["low"].bitwiseXOR(v["high"]))))

            def shifted(n: Column) -> Column:
                head = F.substring(F.lpad(F.bin(v["low"]), 32, "0"), F.lit(1), n)
                out = F.when(n > 0, F.concat(F.substring(head, 1, 1), F.repeat(F.when(F.substring(head, 1, 1) == "1", "0").otherwise("1"), s["pending"]), F.substring(head, F.lit(2), n))).otherwise(F.lit(""))
                power = F.pow(F.lit(2), n).cast("long")
                low = (v["low"] * power).bitwiseAND(F.lit(FULL))
                high = (v["high"] * power + power - 1).bitwiseAND(F.lit(FULL))
                pair = F.struct(low.alias("low"), high.alias("high"), out.alias("out"), F.when(n > 0, 0).otherwise(s["pending"]).alias("pending"))
                return _let(pair, straddled)

            return _let(same, shifted)

        def straddled(v: Column) -> Column:
            mask = (F.lit(FULL) - v["low"]).bitwiseOR(v["high"]).bitwiseAND(F.lit(HALF - 1))
            run = F.when(mask == 0, F.lit(31)).otherwise(F.lit(31) - F.length(F.bin(mask)))

            def apply(k: Column) -> Column:
                power = F.pow(F.lit(2), k).cast("long")
                low = (v["low"] * power).bitwiseAND(F.lit(HALF - 1))
                high = (v["high"] * power + power - 1).bitwiseAND(F.lit(FULL)).bitwiseOR(F.lit(HALF))
                moved = F.struct(F.when(k > 0, low).otherwise(v["low"]).alias("low"), F.when(k > 0, high).otherwise(v["high"]).alias("high"), (v["pending"] + k).cast("int").alias("pending"), F.concat(s["bits"], v["out"]).alias("bits"))
                return moved

            return _let(run, apply)

        width = s["high"] - s["low"] + 1
        low = s["low"] + (width * r["lo"] - (width * r["lo"]) % r["total"]) / r["total"]
        high = s["low"] + (width * r["hi"] - (width * r["hi"]) % r["total"]) / r["total"] - 1
        return _let(F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")), narrowed)

    def finish(s: Column) -> Column:
        first = F.when(s["low"] < QUARTER, "0").otherwise("1")
        other = F.when(s["low"] < QUARTER, "1").otherwise("0")
        return F.concat(s["bits"], first, F.repeat(other, s["pending"] + 1))

    return F.aggregate(ranges, start, step, finish)


def coded(ranges: Column) -> Column:
    """The bytes of array<struct<lo, hi, total>>."""
    return F.unhex(_let(fold(ranges), pack_bits))


class Encoder:
    """Codes intervals of any number of symbols to bytes."""

    def __init__(self):
        self.low, self.high, self.pending, self.bits = 0, FULL, 0, []

    def _emit(self, bits: str) -> None:
        self.bits.append(bits[0] + ("0" if bits[0] == "1" else "1") * self.pending + bits[1:])
        self.pending = 0

    def push(self, lo: int, hi: int, total: int) -> None:
        width = self.high - self.low + 1
        low, high = self.low + width * lo // total, self.low + width * hi // total - 1
        if n := 32 - (low ^ high).bit_length():
            self._emit(format(low >> 32 - n, f"0{n}b"))
            low, high = low << n & FULL, (high << n | (1 << n) - 1) & FULL
        if k := 31 - ((FULL - low | high) & HALF - 1).bit_length():
            self.pending += k
            low, high = low << k & HALF - 1, (high << k | (1 << k) - 1) & FULL | HALF
        self.low, self.high = low, high

    def finish_bits(self) -> str:
        self.pending += 1
        self._emit("0" if self.low < QUARTER else "1")
        return "".join(self.bits)

    def finish(self) -> bytes:
        bits = self.finish_bits()
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")


class Decoder:
    """Reads symbols back. Past the end, bits are zero."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 32
        self.low, self.high, self.code = 0, FULL, self._bits(0, 32)

    def _bits(self, at: int, n: int) -> int:
        first, last = at >> 3, at + n + 7 >> 3
        part = self.data[first:last]
        value = int.from_bytes(part, "big") << 8 * (last - first - len(part))
        return value >> 8 * last - at - n & (1 << n) - 1

    def pull(self, cdf: list[int]) -> int:
        """The next symbol under the cumulative counts 0 = c[0] < c[1] < …"""
        width, total = self.high - self.low + 1, cdf[-1]
        sym = min(bisect_right(cdf, ((self.code - self.low + 1) * total - 1) // width) - 1, len(cdf) - 2)
        low, high = self.low + width * cdf[sym] // total, self.low + width * cdf[sym + 1] // total - 1
        n = 32 - (low ^ high).bit_length()
        low, high = low << n & FULL, (high << n | (1 << n) - 1) & FULL
        k = 31 - ((FULL - low | high) & HALF - 1).bit_length()
        if k:
            low, high = low << k & HALF - 1, (high << k | (1 << k) - 1) & FULL | HALF
        if n + k:
            self.code = ((self.code << n + k | self._bits(self.at, n + k)) - QUARTER * ((1 << k + 1) - 2)) & FULL
            self.at += n + k
        self.low, self.high = low, high
        return sym


#: With fewer streams than this, a step of arrays costs more than a step of each.
FEW = 24


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _narrow(low, high, lo, hi, total):
    """The interval after a symbol: (low, high, bits that go out, those bits, straddling bits)."""
    width = high - low + 1
    low, high = low + width * lo // total, low + width * hi // total - 1
    n = 32 - _bit_length(low ^ high)
    head = low >> (32 - n)
    low, high = low << n & FULL, (high << n | (1 << n) - 1) & FULL
    k = 31 - _bit_length((FULL - low | high) & HALF - 1)
    some = k > 0
    return np.where(some, low << k & HALF - 1, low), np.where(some, (high << k | (1 << k) - 1) & FULL | HALF, high), n, head, k


def _bits_of_events(lane, n, head, pend, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """All bits that go out, lane after lane, and where each lane's begin. An event is n bits, `pend` inverses after the first."""
    order = np.argsort(lane, kind="stable")
    lane, n, head, pend = lane[order], n[order].astype(np.int64), head[order].astype(np.int64), pend[order].astype(np.int64)
    size = n + pend
    at = np.cumsum(size) - size
    first = (head >> (n - 1) & 1).astype(np.uint8)
    bits = np.repeat(1 - first, size)
    bits[at] = first
    for j in range(1, int(n.max(initial=1))):
        some = np.flatnonzero(n > j)
        bits[at[some] + pend[some] + j] = head[some] >> (n[some] - 1 - j) & 1
    return bits, np.concatenate([[0], np.cumsum(np.bincount(lane, size, lanes))]).astype(np.int64)


def encode_lanes(streams: list[np.ndarray], model) -> list[bytes]:
    """The bytes of each stream of symbols under a model (see operators.models.Model)."""
    sizes = np.array([len(x) for x in streams], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sorted_sizes = sizes[order]
    lanes = int((sizes > 0).sum())
    flat = np.concatenate([streams[i] for i in order[:lanes]]).astype(np.int64) if lanes else np.zeros(0, np.int64)
    starts = np.cumsum(sorted_sizes[:lanes]) - sorted_sizes[:lanes]
    low, high, pending = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64), np.zeros(lanes, np.int64)
    prev, events, t, active = np.zeros(lanes, np.int64), [], 0, lanes
    while active >= FEW:
        sym = flat[starts[:active] + t]
        low[:active], high[:active], n, head, k = _narrow(low[:active], high[:active], *model.ranges(prev[:active], t, sym))
        out = np.flatnonzero(n)
        events.append((out.astype(np.int32), n[out].astype(np.uint8), head[out].astype(np.uint32), pending[out].astype(np.uint32)))
        pending[out] = 0
        pending[:active] += k
        prev[:active], t = sym, t + 1
        active = int(np.searchsorted(-sorted_sizes[:lanes], -t, "left"))
    rest = {}
    for i in range(active):
        one = Encoder()
        one.low, one.high, one.pending, last = int(low[i]), int(high[i]), int(pending[i]), int(prev[i])
        for j, s in enumerate(flat[starts[i] + t : starts[i] + sorted_sizes[i]].tolist(), t):
            row = model.row(last, j)
            one.push(row[s], row[s + 1], row[-1])
            last = s
        rest[i] = np.frombuffer(one.finish_bits().encode(), np.uint8) - 48
    ended = np.arange(active, lanes)
    events.append((ended.astype(np.int32), np.ones(len(ended), np.uint8), (low[ended] >= QUARTER).astype(np.uint32), (pending[ended] + 1).astype(np.uint32)))
    bits, at = _bits_of_events(*(np.concatenate(x) for x in zip(*events)), lanes)
    out = [b""] * len(streams)
    for i in range(lanes):
        own = bits[at[i] : at[i + 1]]
        out[order[i]] = np.packbits(np.concatenate([own, rest[i]]) if i in rest else own).tobytes()
    return out


def decode_lanes(payloads: list[bytes], counts: list[int], model) -> list[np.ndarray]:
    """The symbols of each payload. Past a payload's end, bits are zero."""
    sizes = np.array(counts, np.int64)
    order = np.argsort(-sizes, kind="stable")
    sorted_sizes = sizes[order]
    lanes = int((sizes > 0).sum())
    if not lanes:
        return [np.zeros(0, np.int64) for _ in counts]
    gap = bytes(8)
    data = b"".join(payloads[i] + gap for i in order[:lanes])
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    length = np.array([len(payloads[i]) for i in order[:lanes]], np.int64)
    begin = np.cumsum(length + 8) - length - 8

    def read(at: np.ndarray, n: np.ndarray, some: int) -> np.ndarray:
        """n bits (up to 57) at bit `at` of each of the first lanes."""
        byte = np.minimum(at >> 3, length[:some]) + begin[:some]
        window = words[byte].astype(np.uint64) << (at & 7).astype(np.uint64)
        return np.where(n > 0, window >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)

    out = np.zeros(int(sizes.sum()), np.int64)
    starts = np.cumsum(sorted_sizes[:lanes]) - sorted_sizes[:lanes]
    low, high, at = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64), np.full(lanes, 32, np.int64)
    code = read(np.zeros(lanes, np.int64), at, lanes)
    prev, t, active = np.zeros(lanes, np.int64), 0, lanes
    while active >= FEW:
        a = slice(0, active)
        width, total = high[a] - low[a] + 1, model.total(prev[a], t)
        sym, lo, hi = model.find(prev[a], t, ((code[a] - low[a] + 1) * total - 1) // width)
        low[a], high[a], n, _, k = _narrow(low[a], high[a], lo, hi, total)
        code[a] = ((code[a] << n + k | read(at[a], n + k, active)) - QUARTER * ((1 << k + 1) - 2)) & FULL
        at[a] += n + k
        out[starts[a] + t] = prev[a] = sym
        t += 1
        active = int(np.searchsorted(-sorted_sizes[:lanes], -t, "left"))
    for i in range(active):
        one = Decoder(payloads[order[i]])
        one.low, one.high, one.code, one.at, last = int(low[i]), int(high[i]), int(code[i]), int(at[i]), int(prev[i])
        for j in range(t, int(sorted_sizes[i])):
            last = out[starts[i] + j] = one.pull(model.row(int(last), j))
    found = [np.zeros(0, np.int64)] * len(counts)
    for i in range(lanes):
        found[order[i]] = out[starts[i] : starts[i] + sorted_sizes[i]]
    return found

"""Hierarchical packing of token sequences into windows of several lengths.

Documents are encoded and routed to the shortest context tier that holds them; what exceeds the longest tier is cut into
full windows first. Tiers are packed from the longest down. A window's gap is filled with the largest pieces of shorter
tiers that fit, then by cutting one more piece, whose rest goes back to its tier. Windows that can't be filled wait for
the next pool of documents. At a partition's end the rest is cut into windows whose lengths are powers of two, so no
window needs padding. Windows are then dealt to step groups of about equal tokens and attention cost.

Each partition packs what it scans: nothing is shuffled, a task holds one pool at a time, and the same partition always
gives the same windows, so a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_id long"


class Packer:
    """Packs pieces (number, start, length) of one partition. `flush` returns finished windows, lists of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, number, start), ascending
        self.tokens = 0
        self.done: list[list[tuple[int, int, int]]] = []

    def add(self, number: int, length: int, start: int = 0) -> None:
        """Routes tokens [start, length) of a document."""
        top = self.tiers[-1]
        while length - start > top:
            self.done.append([(top, number, start)])
            start += top
        self._route(length - start, number, start)

    def _route(self, length: int, number: int, start: int) -> None:
        if length:
            insort(self.pools[bisect_left(self.tiers, length)], (length, number, start))
            self.tokens += length

    def _largest(self, most: int, below: int):
        """Takes the largest piece of at most `most` tokens from the tiers up to number `below`."""
        for k in range(min(below, bisect_left(self.tiers, most)), -1, -1):
            if i := bisect_right(self.pools[k], (most, 1 << 62, 0)):
                self.tokens -= (piece := self.pools[k].pop(i - 1))[0]
                return piece
        return None

    def _cut(self, gap: int, below: int):
        """Takes `gap` tokens off the smallest longer piece; its rest is routed again."""
        for k in range(below + 1):
            if (i := bisect_right(self.pools[k], (gap, 1 << 62, 0))) < len(self.pools[k]):
                length, number, start = self.pools[k].pop(i)
                self.tokens -= length
                self._route(length - gap, number, start + gap)
                return gap, number, start
        return None

    def flush(self, last: bool) -> list[list[tuple[int, int, int]]]:
        waiting = []
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.pools[k]:
                window, gap = [], self.tiers[k]
                while gap and (piece := self._largest(gap, k) or self._cut(gap, k)):
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    waiting += window
                    break
                self.done.append(window)
        for length, number, start in waiting:
            self._route(length, number, start)
        if last:
            rest = sorted((x for pool in self.pools for x in pool), reverse=True)
            self.pools, self.tokens, window = [[] for _ in self.tiers], 0, []
            left = sum(x[0] for x in rest)
            size = gap = min(self.tiers[-1], 1 << max(0, left.bit_length() - 1))
            for length, number, start in rest:
                while length:
                    taken = min(gap, length)
                    window.append((taken, number, start))
                    length, start, gap, left = length - taken, start + taken, gap - taken, left - taken
                    if not gap:
                        self.done.append(window)
                        window, gap = [], min(size, 1 << max(0, left.bit_length() - 1))
        done, self.done = self.done, []
        return done


def steps(sizes: list[int], step_tokens: int) -> list[int]:
    """A step for each window: longest first to the step with the fewest tokens, then the least attention cost."""
    heap = [(0, 0, k) for k in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, cost, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (tokens + sizes[i], cost + sizes[i] ** 2, k))
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, pool_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document in a window.

    A document is the ids of its whole text (null and empty: none) and end_id; so every row gives at least one piece.
    Null and repeated doc_id are kept as they are: each row is packed for itself. sequence_id and step_id hold the
    partition's number above bit 33. Windows are full: their tokens are a tier's length, or a smaller power of two.
    """

    def run(batches):
        from pyspark import TaskContext

        code, base = encoder(vocabulary, 4), TaskContext.get().partitionId() << 33
        end, packer, held, n, sequence, step = code.pack([end_id]), Packer(tiers), {}, 0, 0, 0

        def out(last: bool):
            nonlocal sequence, step
            windows, rows = packer.flush(last), [[] for _ in range(9)]
            sizes = [sum(x[0] for x in w) for w in windows]
            for window, size, group in zip(windows, sizes, steps(sizes, step_tokens), strict=True):
                at = 0
                for length, number, start in window:
                    doc = held[number]
                    doc[2] -= length
                    crc = zlib.crc32(doc[1][4 * start : 4 * (start + length)])
                    for k, v in zip(rows, (doc[0], start, length, crc, len(doc[1]) // 4, base + sequence, at, size, base + step + group), strict=True):
                        k.append(v)
                    at += length
                    if not doc[2]:
                        del held[number]
                sequence += 1
            step += max(1, round(sum(sizes) / step_tokens)) if sizes else 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], [x.split()[0] for x in SCHEMA.split(", ")])

        waiting = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code.encode(t) + end
                held[n] = [i, ids, len(ids) // 4]
                packer.add(n, len(ids) // 4)
                n, waiting = n + 1, waiting + len(ids) // 4
                if waiting >= pool_tokens:
                    yield out(False)
                    waiting = packer.tokens if packer.tokens < pool_tokens // 2 else 0
        yield out(True)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)

"""Next-symbol models as tables of integer cumulative counts. They are made once and shared by coder and decoder.

A model that codes has `size` symbols, a `hash` that names it, `encode` and `decode` for many streams at once, and gives the
counts of a context, which is the symbol before (0 before the first) and the position. `Model` looks contexts up in a table,
`MockModel` computes them, and `operators.sessions.SessionModel` asks a stateful session.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import latin
from .coder import decode_lanes, encode_lanes

SCALE = 65_536
#: The configuration that the neural model's identity is computed from: layers, width, vocabulary.
LAYERS, WIDTH, VOCABULARY = 12, 768, 50_277


def byte_symbols(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row for each UTF-8 byte, with its position."""
    chars = F.split(latin(F.col(text)), "")
    return docs.filter(F.octet_length(text) > 0).select(*keep, F.posexplode(chars).alias("pos", "ch")).select(*keep, "pos", F.ascii("ch").alias("sym"))


def quantised(p: Column) -> Column:
    """A probability's count: its float32 value times SCALE, at least 1."""
    return F.greatest(F.lit(1), F.floor(p.cast("float").cast("double") * SCALE)).cast("long")


def cumulative(probabilities: DataFrame, *context: str) -> DataFrame:
    """(context…, sym, lo, hi, total) from (context…, sym, p). The total isn't renormalised."""
    counted = probabilities.withColumn("n", quantised(F.col("p")))
    by = W.partitionBy(*context)
    upto = by.orderBy("sym").rowsBetween(W.unboundedPreceding, 0)
    return counted.select(*context, "sym", (F.sum("n").over(upto) - F.col("n")).alias("lo"), F.sum("n").over(upto).alias("hi"), F.sum("n").over(by).alias("total"))


def static_cdf(symbols: DataFrame, size: int = 256) -> DataFrame:
    """An order-0 model of all symbols, seen or not: size rows."""
    seen = symbols.groupBy("sym").count()
    total = seen.agg(F.sum("count").alias("all"))
    every = symbols.sparkSession.range(size).select(F.col("id").cast("int").alias("sym"))
    joined = every.join(F.broadcast(seen), "sym", "left").join(F.broadcast(total))
    return cumulative(joined.select("sym", F.coalesce(F.col("count") / F.col("all"), F.lit(0.0)).alias("p")))


def pair_counts(docs: DataFrame, text: str = "text", *key: str) -> DataFrame:
    """(key…, prev, sym, n): how often each byte follows each other one; 0 stands before the first. Bytes are paired within their
    row and summed up before the shuffle, so no byte is moved."""
    codes = F.transform(F.split(latin(F.col(text)), ""), lambda c: F.ascii(c))
    pairs = F.transform(F.array(codes), lambda v: F.transform(v, lambda x, i: F.when(i > 0, F.get(v, i - 1)).otherwise(0) * 256 + x))[0]
    each = docs.filter(F.octet_length(text) > 0).select(*key, F.explode(pairs).alias("pair")).groupBy(*key, "pair").agg(F.count("*").alias("n"))
    return each.select(*key, F.floor(F.col("pair") / 256).cast("int").alias("prev"), (F.col("pair") % 256).cast("int").alias("sym"), "n")


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(prev, sym, n) over all texts: at most 65,536 rows."""
    return pair_counts(docs, text)


def bigram_cdf(pairs: DataFrame, size: int = 256) -> DataFrame:
    """A model for each context that occurs, over all symbols."""
    totals = pairs.groupBy("prev").agg(F.sum("n").alias("all"))
    every = totals.withColumn("sym", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return cumulative(every.join(pairs, ["prev", "sym"], "left").select("prev", "sym", F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)).alias("p")), "prev")


def mock_logits(spark: SparkSession, size: int, prevs: list[int], steps: int) -> DataFrame:
    """The deterministic stand-in for a neural model: float32 logits by (prev, pos)."""
    grid = spark.createDataFrame([(p,) for p in prevs], "prev int").join(spark.range(steps).select(F.col("id").cast("int").alias("pos"))).join(spark.range(size).select(F.col("id").cast("int").alias("sym")))
    base = (-F.log((F.col("sym") + 1).cast("double")) + F.sin(F.col("sym") * F.lit(0.1).cast("double") + F.col("pos") * F.lit(0.5).cast("double"))).cast("float")
    hot = (7 * F.col("prev") + 13 * F.col("pos")) % size == F.col("sym")
    return grid.withColumn("logit", F.when(hot, (base.cast("double") + 3).cast("float")).otherwise(base))


def softmax(logits: DataFrame, *context: str) -> DataFrame:
    """Adds p: exponentials and results are rounded to float32, the sum is of the rounded ones."""
    by = W.partitionBy(*context)
    e = logits.withColumn("e", F.exp(F.col("logit").cast("double") - F.max("logit").over(by).cast("double")).cast("float"))
    return e.withColumn("p", (F.col("e").cast("double") * (1 / F.sum(F.col("e").cast("double")).over(by))).cast("float")).drop("e")


def log_softmax(logits: DataFrame, *context: str) -> DataFrame:
    by, x = W.partitionBy(*context), F.col("logit").cast("double")
    top = F.max("logit").over(by).cast("double")
    rows = logits.withColumn("top", top)
    total = F.sum(F.exp(x - F.col("top"))).over(by)
    return rows.withColumn("logp", (x - (F.col("top") + F.log(total))).cast("float")).drop("top")


def zipf(spark: SparkSession, size: int = VOCABULARY) -> DataFrame:
    """p proportional to 1 / (sym + 1). The harmonic sum is a constant of the size."""
    total = sum(1.0 / (i + 1) for i in range(size))
    return spark.range(size).select(F.col("id").cast("int").alias("sym"), (F.lit(1.0) / (F.col("id") + 1) / F.lit(total)).alias("p"))


class LaneModel:
    """What the lockstep coder asks of a model: ranges, total and find by context, for arrays, and row for one."""

    size: int
    hash: int

    def encode(self, streams: list[np.ndarray]) -> list[bytes]:
        return encode_lanes(streams, self)

    def decode(self, payloads: list[bytes], counts: list[int]) -> list[np.ndarray]:
        return decode_lanes(payloads, counts, self)


class Model(LaneModel):
    """Cumulative counts by context: one row for all, or one for each symbol that may stand before."""

    def __init__(self, counts):
        self.table = np.atleast_2d(np.asarray(counts, np.int64))
        self.size = self.table.shape[1] - 1
        if self.table.shape[0] not in (1, self.size) or (np.diff(self.table) < 1).any() or self.table[:, 0].any():
            raise ValueError("a model needs ascending counts from 0, for one context or one for each symbol")
        self.hash = zlib.crc32(self.table.astype("<i8").tobytes())
        self.flat, self.width = self.table.ravel(), self.size + 1

    @property
    def cdf(self) -> list[int]:
        return self.rows_of[0]

    @cached_property
    def rows_of(self) -> list[list[int]]:
        return self.table.tolist()

    def _at(self, prev: np.ndarray) -> np.ndarray:
        return prev * self.width if len(self.table) > 1 else np.zeros(len(prev), np.int64)

    def ranges(self, prev, pos, sym):
        at = self._at(prev)
        return self.flat[at + sym], self.flat[at + sym + 1], self.flat[at + self.size]

    def total(self, prev, pos):
        return self.flat[self._at(prev) + self.size]

    def find(self, prev, pos, scaled):
        at, sym = self._at(prev), np.zeros(len(prev), np.int64)
        for k in reversed(range(self.size.bit_length())):
            up = np.minimum(sym + (1 << k), self.size - 1)
            sym = np.where(self.flat[at + up] <= scaled, up, sym)
        return sym, self.flat[at + sym], self.flat[at + sym + 1]

    def row(self, prev: int, pos: int) -> list[int]:
        return self.rows_of[prev if len(self.table) > 1 else 0]


class MockModel(LaneModel):
    """The deterministic stand-in for a neural model: counts by the symbol before and the position, computed as they are needed."""

    def __init__(self, size: int = 320):
        self.size, self.hash = size, zlib.crc32(b"mock %d" % size)
        self.ids = np.arange(size)

    def probabilities(self, prev: np.ndarray, pos: int) -> np.ndarray:
        logits = np.broadcast_to((-np.log(self.ids + 1.0) + np.sin(self.ids * 0.1 + pos * 0.5)).astype(np.float32), (len(prev), self.size)).copy()
        hot = (np.arange(len(prev)), (7 * prev + 13 * pos) % self.size)
        logits[hot] = (logits[hot].astype(np.float64) + 3).astype(np.float32)
        return softmax_array(logits)

    def _rows(self, prev: np.ndarray, pos: int) -> np.ndarray:
        return cumulative_array(self.probabilities(prev, pos))

    def ranges(self, prev, pos, sym):
        rows, each = self._rows(prev, pos), np.arange(len(prev))
        return rows[each, sym], rows[each, sym + 1], rows[:, -1]

    def total(self, prev, pos):
        return self._rows(prev, pos)[:, -1]

    def find(self, prev, pos, scaled):
        rows, each = self._rows(prev, pos), np.arange(len(prev))
        sym = np.minimum((rows[:, 1:] <= scaled[:, None]).sum(1), self.size - 1)
        return sym, rows[each, sym], rows[each, sym + 1]

    def row(self, prev: int, pos: int) -> list[int]:
        return self._rows(np.array([prev]), pos)[0].tolist()


def softmax_array(logits: np.ndarray) -> np.ndarray:
    """`softmax` of float32 rows: exponentials and results are float32, the sum is of the rounded ones, in double precision."""
    e = np.exp(logits.astype(np.float64) - logits.max(-1, keepdims=True).astype(np.float64)).astype(np.float32)
    return (e.astype(np.float64) * (1 / e.astype(np.float64).sum(-1, keepdims=True))).astype(np.float32)


def cumulative_array(p: np.ndarray) -> np.ndarray:
    """`cumulative` of float32 rows: from 0 to the total, which isn't renormalised."""
    counts = np.maximum(1, np.floor(p.astype(np.float64) * SCALE)).astype(np.int64)
    return np.concatenate([np.zeros((*counts.shape[:-1], 1), np.int64), counts.cumsum(-1)], -1)


def train(docs: DataFrame, text: str = "text", order: int = 0) -> Model:
    """The byte model of all texts: 256 counts reach the driver, or with order 1 at most 256 for each byte before, whatever the
    input's size. Contexts that don't occur are even."""
    if not order:
        rows = static_cdf(byte_symbols(docs, text)).orderBy("sym").collect()
        return Model([0, *(r.hi for r in rows)])
    table = np.broadcast_to(np.arange(257), (256, 257)).copy()
    for r in bigram_cdf(contexts(docs, text)).collect():
        table[r.prev, r.sym + 1] = r.hi
    return Model(table)

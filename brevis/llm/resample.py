"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs are hashed into BUCKETS. The raw model counts all documents; the target model counts a bounded sample
of documents that labels mark as good. A document's log importance weight is the sum over its n-grams of
log(target share / raw share). With Gumbel noise added, the k greatest keys are a sample without replacement in proportion
to the weights. The noise is a function of doc_id and the text, so a rerun keeps the same documents.

The cut at rank k is found by counting keys by digits of an integer form, 16 bits at a time: each pass
gathers at most 65,536 counts, and no sort or single task sees all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 1 << 14
#: Labelled documents from which the target model is fitted, at most; those with the least hashed ids.
TARGET_ROWS = 20_000
#: Share of the rows that the sample keeps.
KEEP = 0.85


class Features:
    """n-gram buckets of texts; hashes of words are kept in bounded memory."""

    def __init__(self, buckets: int, keep: int = 400_000):
        self.buckets, self.keep, self.known = buckets, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Buckets of the words and pairs of neighbouring words, with repeats; blank and null texts have none."""
        import xxhash

        found = (text or "").lower().split()
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode(), 7) >> 2
        one = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
        return np.concatenate([one, two]) % np.uint64(self.buckets)


def target_ids(labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """At most `most` ids of documents with quality 1, those with the least hashes: the bounded sample."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def model(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target share / raw share) by bucket, with one added to each count. Only sums by bucket leave the executors."""
    rows = docs.select("doc_id", "text").join(F.broadcast(target.withColumn("good", F.lit(True))), "doc_id", "left")

    def count(batches):
        features, sums = Features(buckets), np.zeros((2, buckets), np.int64)
        for b in batches:
            for text, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist(), strict=True):
                got = np.bincount(features(text).astype(np.int64), minlength=buckets)
                sums[0] += got
                if good:
                    sums[1] += got
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *map(pa.array, sums)], ["bucket", "raw", "target"])

    parts = rows.select("text", "good").mapInArrow(count, "bucket long, raw long, target long")
    got = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas().set_index("bucket").reindex(range(buckets), fill_value=0)
    share = lambda c: np.log((c + 1) / (c.sum() + buckets))
    return share(got["target"].to_numpy(np.float64)) - share(got["raw"].to_numpy(np.float64))


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight and key (log_weight with Gumbel noise) for every row."""

    def score(batches):
        import xxhash

        features = Features(len(ratios))
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            weight = np.array([ratios[features(t).astype(np.int64)].sum() for t in texts], np.float64)
            even = np.array([(xxhash.xxh64_intdigest(f"{i}\n{t}".encode(), 11) + 0.5) / 2.0**64 for i, t in zip(ids, texts, strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(weight), pa.array(weight - np.log(-np.log(even)))], ["doc_id", "log_weight", "key"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, log_weight double, key double")


def rank_cut(codes: DataFrame, k: int) -> int | None:
    """The k-th greatest `code` (a long), or None if there are fewer than k."""
    low, left = 0, k
    rows = codes.select((F.shiftrightunsigned("code", 48).bitwiseXOR(F.lit(1 << 15))).alias("d0"), *(F.shiftrightunsigned("code", 48 - 16 * d).bitwiseAND(F.lit(0xFFFF)).alias(f"d{d}") for d in (1, 2, 3)))
    for step in range(4):
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(f"d{step}").count().collect()), reverse=True)
        for digit, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return None
        low = low << 16 | digit
        rows = rows.filter(F.col(f"d{step}") == digit)
    low ^= 1 << 63
    return low - (1 << 64) if low >> 63 else low


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, key and kept for every row; kept are the round(keep * rows) greatest keys.

    Null, empty and blank texts have weight 0 and take part by their noise. Rows with equal doc_id and text have equal
    keys; if such a tie lies at the cut, all of it is kept. Keys are compared to six decimals.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(scored(own, model(own, target_ids(labels, target_rows), buckets)).withColumn("code", F.round(F.col("key") * 1e6).cast("long")))
    k = round(keep * rows.count())
    least = rank_cut(rows, k) if k else None
    kept = F.lit(False) if least is None else F.col("code") >= least
    return rows.select("doc_id", "log_weight", "key", kept.alias("kept"))

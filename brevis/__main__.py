"""Compresses or restores the texts of Parquet files: spark-submit or `python -m brevis`.

    python -m brevis train IN MODEL [--context]
    python -m brevis compress IN OUT --model MODEL [--chunked --chunk-size 128 --overlap 16]
    python -m brevis decompress IN OUT --model MODEL [--chunked]

A model is a Parquet folder of cumulative counts, so both directions read the same one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.models import Model
from .plans import compress as P


def load_model(spark: SparkSession, path: str) -> Model:
    return Model([r.counts for r in spark.read.parquet(path).orderBy("context").collect()])


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame(list(enumerate(model.table.tolist())), "context int, counts array<long>").coalesce(1).write.mode("overwrite").parquet(path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="brevis", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("task", choices=("train", "compress", "decompress"))
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--model", help="folder of the model")
    parser.add_argument("--context", action="store_true", help="train counts by the byte before")
    parser.add_argument("--chunked", action="store_true", help="independent chunks")
    parser.add_argument("--chunk-size", type=int, default=128)
    parser.add_argument("--overlap", type=int, default=16)
    parser.add_argument("--key", default="doc_id")
    parser.add_argument("--text", default="text")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName("brevis").getOrCreate()
    rows = spark.read.parquet(o.source)
    if o.task == "train":
        save_model(spark, P.train(rows, o.text, int(o.context)), o.target)
        return
    if not o.model:
        parser.error("--model is needed")
    model = load_model(spark, o.model)
    if o.task == "compress":
        out = P.compress_chunked(rows, model, o.chunk_size, o.overlap, o.key, o.text) if o.chunked else P.compress(rows, model, o.key, o.text)
        out = P.statistics(out)
    else:
        out = (P.decompress_chunked if o.chunked else P.decompress)(rows, model, o.key)
    out.write.mode("overwrite").parquet(o.target)


if __name__ == "__main__":
    main()

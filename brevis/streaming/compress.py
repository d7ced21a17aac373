"""Compression of a stream: each row on its own, under a model made beforehand, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.compress import Model, compress


def compress_stream(spark: SparkSession, path: str, schema: str, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A streaming DataFrame of containers for the rows of Parquet files that arrive under a path."""
    return compress(spark.readStream.schema(schema).parquet(path), model, key, text)

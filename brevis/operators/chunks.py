"""Texts as overlapping chunks of tokens that can be coded and decoded independently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or size + overlap > 65_535:
        raise ValueError("a chunk needs 1 <= size, 0 <= overlap and size + overlap <= 65,535")


def split_tokens(tokens: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_id, tokens, output_start, output_count>>: chunk k owns [k * size, (k + 1) * size) and begins up to `overlap` tokens before."""
    validate(size, overlap)
    none = F.array().cast("array<struct<chunk_id:int,tokens:array<int>,output_start:int,output_count:int>>")

    def cut(whole: Column) -> Column:
        def chunk(k: Column) -> Column:
            begin = F.greatest(F.lit(0), k * size - overlap)
            end = F.least(F.size(whole), (k + 1) * size)
            return F.struct(k.alias("chunk_id"), F.slice(whole, begin + 1, end - begin).alias("tokens"), (k * size).alias("output_start"), (end - k * size).alias("output_count"))

        ids = F.sequence(F.lit(0), F.ceil(F.size(whole) / size).cast("int") - 1)
        return F.when(F.size(whole) == 0, none).otherwise(F.transform(ids, chunk))

    return F.transform(F.array(tokens), cut)[0]  # the tokens are computed once


def exploded(docs: DataFrame, tokens: Column, size: int, overlap: int, *keep: str) -> DataFrame:
    """One row for each chunk; texts without tokens have none."""
    return docs.select(*keep, F.explode(split_tokens(tokens, size, overlap)).alias("c")).select(*keep, "c.*")


def own_tokens(tokens: Column, output_count: Column) -> Column:
    """A chunk's tokens without what it repeats of its predecessor."""
    return F.slice(tokens, F.size(tokens) - output_count + 1, output_count)

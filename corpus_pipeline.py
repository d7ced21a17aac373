"""A corpus from raw documents to packed windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
documents, whatever further ones there are.

Null and empty texts have under 20 words, so the quality rules reject them; a text that line dedup empties stays as an empty
row until near dedup, where texts without a word are one group. Rows without doc_id and rows that share one are rows of their
own: near dedup keeps the row with the least doc_id (one without only where its group has no other) and, of equal rows, one;
decontamination goes by the row's text, not by its doc_id alone. Ties in line dedup go by (doc_id, hash of the text, place).
Very long texts are worked on whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brevis.llm import decontaminate, linededup, packing, rules, simhash
from brevis.llm.common import drop_dir, fresh_dir, table
from brevis.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occur earlier go; texts of which nothing else is left stay as empty rows."""
    return linededup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are left become pieces of training windows."""
    return packing.pack(docs, vocabulary(), end_id=2)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

#: Hashes, fingerprints and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. Each stage's rows are written in the shared folder and read again; what no later stage
    reads goes."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop_dir(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

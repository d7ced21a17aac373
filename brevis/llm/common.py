"""What several operators share: expressions that are evaluated once, words, hashes, and files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class body of a regular expression.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once although body names it often."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row: neither projections nor filters above are merged into it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def running(values: Column, join) -> Column:
    """Running totals of an array (of up to 2^26 elements) under an associative join(earlier, later), in n log n steps."""

    def wider(v: Column, k: Column) -> Column:
        return F.when(F.size(v) <= k, v).otherwise(F.transform(v, lambda x, i: F.when(i >= k, join(F.get(v, i - k), x)).otherwise(x)))

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(26))), values, wider)


def words(text: Column) -> Column:
    """The words of a text, runs of anything but white space; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE}]+")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, set from spark.checkpoint.dir. Where neither is
    given, it is a folder in the warehouse, which is shared as well; never a temporary folder of one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """As `cut`, by a table under a path in the shared folder: numbers take half the room of a checkpoint."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def open_store(uri: str):
    """(file system, path) of a URI, for local, HDFS and object stores alike."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def publish(store, draft: str, name: str) -> None:
    """Gives a complete draft its name. What an attempt that died has left there goes; attempts write the same."""
    from pyarrow.fs import FileType

    if store.get_file_info(name).type != FileType.NotFound:
        store.delete_file(name)
    store.move(draft, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

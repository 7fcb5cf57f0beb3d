"""Shared places and small expressions for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import shared_folder, shuffle_files_go

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_024
"""Rows that go to Python at once: of texts or bitmaps, Spark's default of 10,000 makes tens of megabytes, in several copies."""
BUCKET_ROWS, MOST_BUCKETS = 200_000, 100_000
"""Rows in a bucket of a bucketed table, and the most buckets that Spark takes by default."""
HOT_ROWS, HOT_KEYS = 1_000, 10_000
"""A key is hot from this many rows on, and from one in ``HOT_KEYS`` of all rows; so there are at most ``HOT_KEYS``."""

__all__ = ["bucketed", "discard", "hot_keys", "parts", "salted_join", "saved", "shared_folder", "small_batches", "table"]


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_ROWS``, for a plan that is run by whoever it is returned to."""
    spark.conf.set(BATCH, BATCH_ROWS)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, in small batches where it goes through Python, and read again."""
    with _small_batches(df.sparkSession):
        return storage.saved(df, name)


def hot_keys(sizes: DataFrame, keys: list[str], total: int | None) -> DataFrame:
    """Of ``sizes`` (keys, copies) the hot keys with the number of ``salts`` that deal their rows out: at most ``HOT_KEYS`` rows."""
    least = max(HOT_ROWS, -(-(total or 0) // HOT_KEYS))
    return sizes.filter(F.col("copies") >= least).select(*keys, F.ceil(F.col("copies") / least).cast("int").alias("salts"))


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each key). Rows of hot keys are dealt out by ``salts`` and a hash of ``spread``.

    ``hot`` comes from ``hot_keys``, so what is broadcast is bounded whatever the data; no key gathers more rows in a task than
    that bound allows.
    """
    hot = F.broadcast(hot)
    cold = rows.join(hot, keys, "left_anti").join(keyed, keys, how)
    dealt = rows.join(hot, keys).withColumn("salt", F.pmod(F.xxhash64(spread), F.col("salts")).cast("int")).drop("salts")
    copies = keyed.join(hot, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return cold.unionByName(dealt.join(copies, [*keys, "salt"], how).drop("salt"))


def bucketed(df: DataFrame, keys: list[str], rows: int, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``step`` of ``df`` dealt by ``keys``, written to the shared folder as a table in buckets of ``keys`` and read again.

    Joins on all of ``keys`` then read the table's buckets without moving its rows. ``step`` must leave rows where they are.
    """
    spark = df.sparkSession
    count = min(MOST_BUCKETS, max(parts(df), -(-rows // BUCKET_ROWS)))
    unique = f"{name}_{uuid.uuid4().hex}"
    dealt = step(df.repartition(count, *keys))
    with shuffle_files_go(spark):
        dealt.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{unique}").bucketBy(count, *keys).saveAsTable(unique, format="parquet")
    return spark.table(unique)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from ``saved`` that no table yet to be computed reads."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """The number of shuffle partitions in force."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

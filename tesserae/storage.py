"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Shuffle files go as soon as the table that needed them is written."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is absent, in a local session, a folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TESSERAE_LOCAL_CHECKPOINT")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.environ["TESSERAE_LOCAL_CHECKPOINT"] = tempfile.mkdtemp(prefix="tesserae-")
    return root.rstrip("/")


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

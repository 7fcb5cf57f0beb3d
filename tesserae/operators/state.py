"""Run history, recent files, cached results and batches as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_safe

HISTORY, RECENT = 50, 5


def newest(df: DataFrame, n: int, by: str = "timestamp", key: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows (of each group ``within``), newest first, one for each ``key``.

    The limit is pushed below the shuffle (a window group limit), so a group of any size sends ``n`` rows a task.
    """
    rows = df.withColumn("_day", F.lit(0)) if not within else df
    if key:
        once = F.row_number().over(Window.partitionBy(*within, *key).orderBy(F.desc(by)))
        rows = rows.withColumn("_n", once).filter("_n = 1").drop("_n")
    ties = sorted(c for c, t in df.dtypes if c != by and not t.startswith(("map", "array", "struct")))
    rank = F.row_number().over(Window.partitionBy(*(within or ["_day"])).orderBy(F.desc(by), *ties))
    return rows.withColumn("position", rank).filter(F.col("position") <= n).drop("_day")


def history_statistics(df: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return df.agg(F.count("*").alias("total"), n("success").alias("succeeded"), n("failed").alias("failed"), n("cancelled").alias("cancelled"))


def latest_success(df: DataFrame) -> DataFrame:
    good = df.filter(F.col("status") == "success")
    return good.groupBy("source_path").agg(F.max("timestamp").alias("timestamp"), F.count("*").alias("n"))


def presets(df: DataFrame) -> DataFrame:
    """The newest preset of each name, in the order of names whatever their case."""
    once = df.groupBy("name").agg(F.max_by("parameters", "saved").alias("parameters"), F.max("saved").alias("saved"))
    # A row for each saved set of parameters: a window without partitions is small here.
    return once.withColumn("position", F.row_number().over(Window.orderBy(F.lower("name"), "name")))


def cache_key(*parts: Column, length: int = 16) -> Column:
    """The first digits of a SHA-256 over the parts as a JSON list, in which null and text of any kind stay apart."""
    told = F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(json_safe(p.cast("string")), F.lit("null")) for p in parts)), F.lit("]"))
    return F.substring(F.sha2(told, 256), 1, length)


def cache_statistics(df: DataFrame) -> DataFrame:
    """Entries and features for each profile, and a row (null) for all."""
    return df.withColumn("profile_id", F.coalesce("profile_id", F.lit("unknown"))).rollup("profile_id").agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("feature_count"), F.lit(0)).cast("long").alias("features")
    )


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a batch, and a line that tells them."""
    n = lambda s: F.count_if(F.col("status") == s)
    totals = outcomes.agg(F.count("*").alias("total"), n("success").alias("succeeded"), n("failed").alias("failed"), n("cancelled").alias("cancelled"), F.coalesce(F.sum("feature_count"), F.lit(0)).cast("long").alias("features"))
    told = F.when(F.col("cancelled") > 0, F.format_string("%d/%d processed, %d failed, %d cancelled", "succeeded", "total", "failed", "cancelled")).when(
        F.col("failed") > 0, F.format_string("%d/%d processed, %d failed", "succeeded", "total", "failed")
    )
    return totals.withColumn("summary", told.otherwise(F.format_string("%d/%d processed", "succeeded", "total")))


def version_parts(version: Column) -> Column:
    """``vX.Y.Z`` with any suffix as array<int>, padded to three; (0, 0, 0) if it is none."""
    digits = F.regexp_extract(version, r"^[vV]?([0-9]+(?:\.[0-9]+)*)", 1)
    parts = F.transform(F.split(F.when(digits == "", "0").otherwise(digits), r"\."), lambda p: p.cast("int"))
    return F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(0), 3 - F.size(parts))))


def clock(seconds: Column) -> Column:
    """``M:SS`` or ``H:MM:SS``."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))

"""Histograms, thresholds, palettes and statistics of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import pixels


def _bins() -> WindowSpec:
    """A bin table has at most 256 rows for each raster, so windows over it are small."""
    return Window.partitionBy("raster_id").orderBy("v")


def histogram(df: DataFrame, value: str = "v") -> DataFrame:
    return df.groupBy("raster_id", F.col(value).alias("v")).agg(F.count("*").alias("n"))


def dominant(df: DataFrame, value: str = "v") -> DataFrame:
    """The most frequent value; of equally frequent ones the first in row-major order."""
    place = F.struct("y", "x")
    each = df.groupBy("raster_id", F.col(value).alias("v")).agg(F.count("*").alias("n"), F.min(place).alias("at"))
    key = F.struct(F.col("n"), -F.col("at.y"), -F.col("at.x"))
    return each.groupBy("raster_id").agg(F.max_by("v", key).alias("v"), F.max("n").alias("n"))


def _splits(df: DataFrame) -> DataFrame:
    """For each value of the histogram the pixels at or below it (``wb``), all (``w``), and the variance ``between`` both sides."""
    bins = histogram(df)
    upto = _bins().rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("raster_id")
    at = (
        bins.withColumn("wb", F.sum("n").over(upto).cast("double"))
        .withColumn("sb", F.sum(F.col("v") * F.col("n")).over(upto).cast("double"))
        .withColumn("w", F.sum("n").over(all_).cast("double"))
        .withColumn("s", F.sum(F.col("v") * F.col("n")).over(all_).cast("double"))
        .withColumn("wf", F.col("w") - F.col("wb"))
    )
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.col("wf")
    return at.withColumn("between", F.when(F.col("wf") > 0, F.col("wb") * F.col("wf") * gap * gap).otherwise(F.lit(0.0)))


def _thresholds(df: DataFrame) -> DataFrame:
    """``otsu, median`` of each raster from one histogram."""
    best = F.when(F.max("between") > 0, F.max_by("v", F.struct("between", -F.col("v")))).otherwise(0)
    middle = F.min(F.when(F.col("wb") > F.floor(F.col("w") / 2), F.col("v")))
    return _splits(df).groupBy("raster_id").agg(best.cast("int").alias("otsu"), middle.cast("int").alias("median"))


def otsu(df: DataFrame) -> DataFrame:
    """``threshold`` with the first greatest variance between classes; 0 for a constant raster."""
    return _thresholds(df).select("raster_id", F.col("otsu").alias("threshold"))


def upper_median(df: DataFrame) -> DataFrame:
    """``threshold``: the smallest value with more than half of the pixels (rounded down) at or below it."""
    return _thresholds(df).select("raster_id", F.col("median").alias("threshold"))


def auto_threshold(df: DataFrame) -> DataFrame:
    """Otsu's threshold, or the upper median where that is 0."""
    return _thresholds(df).select("raster_id", F.when(F.col("otsu") != 0, F.col("otsu")).otherwise(F.col("median")).alias("threshold"))


def quantize(df: DataFrame, max_colors: int = 8) -> DataFrame:
    """``label`` by frequency where there are at most ``max_colors`` values, else by ranges of values.

    The palette has at most 256 rows for each raster; its size decides how it is joined.
    """
    each = df.groupBy("raster_id", "v").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("at"))
    kinds = F.count("*").over(Window.partitionBy("raster_id"))
    rank = F.row_number().over(Window.partitionBy("raster_id").orderBy(F.desc("n"), "at")) - 1
    palette = each.select("raster_id", "v", F.when(kinds <= max_colors, rank).otherwise(pixels.bucket_label(F.col("v"), max_colors)).cast("int").alias("label"))
    return df.join(palette, ["raster_id", "v"]).select("raster_id", "y", "x", "label")


def kmeans_1d(df: DataFrame, k: int = 8, iterations: int = 10) -> DataFrame:
    """``label`` by k-means on values. Exactly repeatable: it runs on the histogram, from evenly spread centres, and labels
    follow the order of the centres. Per raster the histogram is one row of at most 256 bins."""
    bins = histogram(df).groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("bins"))
    low, high = F.get("bins", F.lit(0))["v"], F.element_at("bins", -1)["v"]
    out = bins.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: low + (high - low) * (i + 0.5) / k))
    near = lambda v, c: F.array_position(F.transform(c, lambda m: F.abs(m - v)), F.array_min(F.transform(c, lambda m: F.abs(m - v))))

    def centre(m, i):
        own = F.filter("bins", lambda b: near(b["v"], F.col("c")) == i + 1)
        n = F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s + b["n"])
        return F.when(n > 0, F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s + b["n"] * b["v"]) / n).otherwise(m)

    for _ in range(iterations):
        out = out.withColumn("c", F.array_sort(F.transform("c", centre)))
    palette = out.select("raster_id", F.explode("bins").alias("b"), "c").select("raster_id", "b.v", (near(F.col("b.v"), F.col("c")) - 1).cast("int").alias("label"))
    return df.join(palette, ["raster_id", "v"]).select("raster_id", "y", "x", "label")


def tile_statistics(df: DataFrame, tile: int) -> DataFrame:
    at = lambda c: F.expr(f"{c} div {tile}").cast("int")
    return df.groupBy("raster_id", at("y").alias("ty"), at("x").alias("tx")).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").cast("long").alias("total")
    )


def iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two masks (``bit``): intersection, union, IoU, precision and recall of ``a`` against ``b``."""
    both = a.withColumnRenamed("bit", "p").join(b.withColumnRenamed("bit", "t"), ["raster_id", "y", "x"])
    n = lambda c: F.count_if(c)
    p, t = F.col("p") == 1, F.col("t") == 1
    s = both.groupBy("raster_id").agg(n(p & t).alias("intersection"), n(p | t).alias("union_n"), n(p).alias("predicted"), n(t).alias("truth"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.bround(F.col(x) / F.col(y), 6)).otherwise(0.0)
    return s.select("raster_id", "intersection", "union_n", ratio("intersection", "union_n").alias("iou"), ratio("intersection", "predicted").alias("precision"), ratio("intersection", "truth").alias("recall"))


def boundary_f1(a: DataFrame, b: DataFrame, tolerance: int = 1) -> DataFrame:
    """``boundary_f1`` of mask ``a`` against ``b`` (``bit``): a boundary pixel (1 beside a 0) is met if the other mask has one
    within a round neighbourhood of ``tolerance``."""
    from . import stencils

    def edge(mask: DataFrame, name: str) -> DataFrame:
        inner = stencils.erode_round(mask.select("raster_id", "y", "x", "bit", F.col("bit").alias("own")), 1)
        rim = inner.select("raster_id", "y", "x", (F.col("own") - F.col("bit")).alias(name))
        return stencils.dilate_round(rim.withColumn(f"{name}_near", F.col(name)), tolerance, f"{name}_near")

    both = edge(a, "p").join(edge(b, "t"), ["raster_id", "y", "x"])
    n = lambda *c: F.count_if(F.lit(True) if not c else F.col(c[0]) * F.col(c[1]) == 1)
    s = both.groupBy("raster_id").agg(F.sum("p").alias("n_p"), F.sum("t").alias("n_t"), n("p", "t_near").alias("hit_p"), n("t", "p_near").alias("hit_t"))
    precision, recall = F.col("hit_p") / F.nullif("n_p", F.lit(0)), F.col("hit_t") / F.nullif("n_t", F.lit(0))
    return s.select("raster_id", F.bround(F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)), 6).alias("boundary_f1"))

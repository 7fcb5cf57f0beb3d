"""Neighbourhoods on dense grids, as windows over rows and then columns. No joins; borders are clipped or repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import saved


def across_row() -> WindowSpec:
    return Window.partitionBy("raster_id", "y").orderBy("x")


def down_column() -> WindowSpec:
    return Window.partitionBy("raster_id", "x").orderBy("y")


def _separable(df: DataFrame, value: str, radius: int, f) -> DataFrame:
    if radius <= 0:
        return df
    wide = df.withColumn(value, f(value).over(across_row().rowsBetween(-radius, radius)))
    return wide.withColumn(value, f(value).over(down_column().rowsBetween(-radius, radius)))


def dilate(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return _separable(df, value, radius, F.max)


def erode(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return _separable(df, value, radius, F.min)


def opened(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return dilate(erode(df, radius, value), radius, value)


def closed(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return erode(dilate(df, radius, value), radius, value)


def _near(value: str, window, step: int) -> Column:
    """The value ``step`` places on, or the pixel's own beyond the border."""
    moved = F.lag(value, -step) if step < 0 else F.lead(value, step)
    return F.coalesce(moved.over(window), F.col(value))


def sobel(df: DataFrame) -> DataFrame:
    """``mag``: |gx| + |gy| of the 3 x 3 operator, the border repeated."""
    across = df.withColumn("d", _near("v", across_row(), 1) - _near("v", across_row(), -1)).withColumn("s", _near("v", across_row(), -1) + 2 * F.col("v") + _near("v", across_row(), 1))
    gx = _near("d", down_column(), -1) + 2 * F.col("d") + _near("d", down_column(), 1)
    gy = _near("s", down_column(), 1) - _near("s", down_column(), -1)
    return across.select("raster_id", "y", "x", (F.abs(gx) + F.abs(gy)).cast("int").alias("mag"))


#: The weights of a Gaussian by its width, as the binomial rows are usually rounded.
KERNELS = {1: (1,), 3: (1, 2, 1), 5: (1, 4, 6, 4, 1), 7: (2, 7, 14, 18, 14, 7, 2)}


def _weighted(df: DataFrame, value: str, window, weights: tuple[int, ...]) -> DataFrame:
    """``raster_id, y, x, s``: the weighted sum around a pixel, the border repeated.

    Beyond the border stands the last pixel that there is, so each step falls back on the one before it. (A frame that is
    open to its end would be read anew for each pixel.)
    """
    radius = len(weights) // 2
    moved = [f(value, k).over(window).alias(f"_{n}{k}") for k in range(1, radius + 1) for n, f in (("b", F.lag), ("a", F.lead))]
    near = lambda n, k: F.coalesce(*(f"_{n}{i}" for i in range(k, 0, -1)), value)
    terms = [w * (F.col(value) if i == radius else near("ba"[i > radius], abs(i - radius))) for i, w in enumerate(weights)]
    return df.select("raster_id", "y", "x", value, *moved).select("raster_id", "y", "x", reduce(Column.__add__, terms).alias("s"))


def gaussian_blur(df: DataFrame, size: int = 3) -> DataFrame:
    """``v``: weighted means across and down, halves to the even number, the border repeated."""
    weights = KERNELS[size]
    sums = _weighted(_weighted(df, "v", across_row(), weights), "s", down_column(), weights)
    return sums.select("raster_id", "y", "x", F.rint(F.col("s") / sum(weights) ** 2).cast("int").alias("v"))


def _ellipse(radius: int) -> list[int]:
    """Half-widths of a round kernel's rows, from the top."""
    return [round(radius * ((radius * radius - dy * dy) ** 0.5) / radius) if radius else 0 for dy in range(-radius, radius + 1)]


def _round(df: DataFrame, radius: int, value: str, f, pick) -> DataFrame:
    if radius <= 0:
        return df
    widths = _ellipse(radius)
    wide = df.select("*", *(f(value).over(across_row().rowsBetween(-w, w)).alias(f"_w{w}") for w in sorted(set(widths))))
    rows = []
    for dy, w in zip(range(-radius, radius + 1), widths, strict=True):
        moved = F.lag(f"_w{w}", -dy) if dy < 0 else F.lead(f"_w{w}", dy)
        rows.append(F.col(f"_w{w}") if dy == 0 else moved.over(down_column()))
    return wide.withColumn(value, pick(*rows)).drop(*(f"_w{w}" for w in set(widths)))


def dilate_round(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    """Any 1 in a round neighbourhood; outside counts as nothing."""
    return _round(df, radius, value, F.max, F.greatest)


def erode_round(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return _round(df, radius, value, F.min, F.least)


def opened_round(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return dilate_round(erode_round(df, radius, value), radius, value)


def closed_round(df: DataFrame, radius: int = 1, value: str = "bit") -> DataFrame:
    return erode_round(dilate_round(df, radius, value), radius, value)


#: Fixed value: the tangent of 22.5 degrees in units of 1 / 32768.
TANGENT = 13_573


def canny_classes(df: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    """``class``: 2 where the gradient (|gx| + |gy|) is the greatest across its edge and above ``high``, 1 above ``low``, else 0."""
    near = lambda c, w, k: _near(c, w, k)
    # Down first: what comes from a blur lies by columns. A gradient's neighbours in its row are then at hand as well.
    sums = df.withColumn("d", near("v", down_column(), 1) - near("v", down_column(), -1)).withColumn("s", near("v", down_column(), -1) + 2 * F.col("v") + near("v", down_column(), 1))
    gx = near("s", across_row(), 1) - near("s", across_row(), -1)
    gy = near("d", across_row(), -1) + 2 * F.col("d") + near("d", across_row(), 1)
    grad = sums.select("raster_id", "y", "x", gx.cast("long").alias("gx"), gy.cast("long").alias("gy")).withColumn("m", F.abs("gx") + F.abs("gy"))
    beside = lambda c, w, k: F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w), F.lit(0))
    grad = grad.withColumn("left", beside("m", across_row(), -1)).withColumn("right", beside("m", across_row(), 1))
    names = {f"{n}_{c}": beside(c, down_column(), k) for c in ("m", "left", "right") for n, k in (("up", -1), ("down", 1))}
    around = grad.select("*", *(v.alias(k) for k, v in names.items()))
    m, x, y = F.col("m"), F.abs("gx"), F.abs("gy") * 32_768
    flat, steep = y < x * TANGENT, y > x * TANGENT + x * 65_536
    same = (F.col("gx") < 0) == (F.col("gy") < 0)
    across = (m > F.when(same, F.col("up_left")).otherwise(F.col("up_right"))) & (m > F.when(same, F.col("down_right")).otherwise(F.col("down_left")))
    top = F.when(flat, (m > F.col("left")) & (m >= F.col("right"))).when(steep, (m > F.col("up_m")) & (m >= F.col("down_m"))).otherwise(across)
    return around.select("raster_id", "y", "x", F.when(top & (m > high), 2).when(top & (m > low), 1).otherwise(0).alias("class"))


def canny(df: DataFrame, low: int = 50, high: int = 150, blur: int = 3) -> DataFrame:
    """``bit``: 1 on edges above ``high`` and on those above ``low`` that touch one, through any number of others.

    What touches is a component of the edges (8 neighbours), which are labelled in tiles and joined across their seams; those
    with a strong pixel stay.
    """
    from .regions import label_components

    classes = saved(canny_classes(gaussian_blur(df, blur), low, high), "canny-classes")
    found = saved(label_components(classes.withColumn("label", F.when(F.col("class") > 0, 1)), 8), "canny-components")
    strong = found.join(classes.filter("class = 2"), ["raster_id", "y", "x"], "left_semi").select("raster_id", "component").distinct()
    edges = found.join(strong, ["raster_id", "component"], "left_semi").select("raster_id", "y", "x", F.lit(1).alias("bit"))
    return classes.select("raster_id", "y", "x").join(edges, ["raster_id", "y", "x"], "left").withColumn("bit", F.coalesce("bit", F.lit(0)))


def median(df: DataFrame, radius: int = 1) -> DataFrame:
    """``v``: the upper median of the clipped square. Lists of at most (2 radius + 1) squared values are sorted in place."""
    lists = df.withColumn("l", F.collect_list("v").over(across_row().rowsBetween(-radius, radius)))
    lists = lists.withColumn("l", F.array_sort(F.flatten(F.collect_list("l").over(down_column().rowsBetween(-radius, radius)))))
    return lists.select("raster_id", "y", "x", F.get("l", F.expr("size(l) div 2")).alias("v"))


def majority(df: DataFrame, radius: int = 1, value: str = "label") -> DataFrame:
    """The most frequent label of the clipped square; of equally frequent ones the pixel's own, then the smallest."""
    if radius <= 0:
        return df
    lists = df.withColumn("l", F.collect_list(value).over(across_row().rowsBetween(-radius, radius)))
    lists = lists.withColumn("l", F.flatten(F.collect_list("l").over(down_column().rowsBetween(-radius, radius))))
    own = F.col(value)
    rank = lambda c: F.struct(F.size(F.filter("l", lambda z: z == c)).alias("n"), (c == own).alias("own"), (-c).alias("low"), c.alias("label"))
    best = F.array_max(F.transform(F.array_distinct("l"), rank))
    return lists.withColumn(value, best["label"]).drop("l")

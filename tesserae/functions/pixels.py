"""Pixel-wise expressions: values are integers from 0 to 255."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def grayscale(r: Column, g: Column | None = None, b: Column | None = None) -> Column:
    """One band as it is; else 0.299 r + 0.587 g + 0.114 b, halves to the even number, a missing blue being 0."""
    if g is None:
        return clamp(r).cast("int")
    weighted = r.cast("double") * 0.299 + g.cast("double") * 0.587 + (F.lit(0.0) if b is None else b.cast("double")) * 0.114
    return clamp(F.rint(weighted)).cast("int")


def as_rgb(*bands: Column) -> Column:
    """One band three times; two bands and 0; the first three of more."""
    if len(bands) == 1:
        return F.array(bands[0], bands[0], bands[0])
    return F.array(*bands[:3]) if len(bands) > 2 else F.array(*bands, F.lit(0))


def threshold(v: Column, at: Column | int, polarity: str = "high") -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    if polarity not in ("high", "low"):
        raise ConfigurationError(f"polarity {polarity!r} is neither 'high' nor 'low'")
    return F.when(v >= at if polarity == "high" else v <= at, 1).otherwise(0)


def threshold_strict(v: Column, at: Column | int, polarity: str = "high") -> Column:
    """As ``threshold``, but a value at the threshold itself is low."""
    at = F.lit(at) if isinstance(at, int) else at
    if polarity not in ("high", "low"):
        raise ConfigurationError(f"polarity {polarity!r} is neither 'high' nor 'low'")
    return F.when(v > at if polarity == "high" else v <= at, 1).otherwise(0)


def first_band(*bands: Column) -> Column:
    """Gray of one or two bands by the first alone, of three or more as ``grayscale`` has it."""
    return grayscale(bands[0]) if len(bands) < 3 else grayscale(*bands[:3])


def bucket_label(v: Column, max_colors: int = 8) -> Column:
    """Labels by equal ranges of values."""
    buckets = max(2, round(math.sqrt(max_colors)))
    size = max(1, 256 // buckets)
    return F.least(F.lit(max_colors - 1), F.floor(v / size)).cast("int")

"""Colour and pixel statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.params import DEFAULT, Params

CHANNELS = ("b", "g", "r")


def medians(px: DataFrame, *keys: str) -> DataFrame:
    return px.groupBy(*keys).agg(*[F.median(c).alias(c) for c in CHANNELS])


def dominant_bucket(px: DataFrame, key: str, background: tuple[int, int, int]) -> DataFrame:
    """The bucket of 32 levels a channel with the greatest count times distance to the background; the least bucket on ties."""
    buckets = [F.least(F.floor(F.col(c) / 32) * 32, F.lit(224)).cast("long").alias(f"k{c}") for c in CHANNELS]
    n = px.select(key, *buckets).groupBy(key, *[f"k{c}" for c in CHANNELS]).agg(F.count("*").alias("n"))
    squares = [(F.least(F.col(f"k{c}") + 16, F.lit(240)) - F.lit(v)) * (F.least(F.col(f"k{c}") + 16, F.lit(240)) - F.lit(v)) for c, v in zip(CHANNELS, background, strict=True)]
    worth = F.col("n") * (F.lit(24.0) + F.sqrt((squares[0] + squares[1] + squares[2]).cast("double")))
    best = n.withColumn("worth", worth).groupBy(key).agg(F.max_by(F.struct("kb", "kg", "kr", "n"), F.struct("worth", -F.col("kb"), -F.col("kg"), -F.col("kr"))).alias("m"))
    return best.select(key, *[F.least(F.col(f"m.k{c}") + 16, F.lit(240)).alias(c) for c in CHANNELS], F.col("m.n").alias("n"))


def hole_statistics(px: DataFrame, key: str, p: Params = DEFAULT) -> DataFrame:
    """black (share of dark pixels), std over all channels, delta of the medians inside and outside; px has a flag `hole`."""
    dark = F.greatest(*CHANNELS) < p.black_level
    inside, lit_up = F.col("hole"), ~F.col("hole") & (F.greatest(*CHANNELS) > p.black_level)
    sums = [F.sum(F.when(inside, F.col(c))) for c in CHANNELS]
    squares = [F.sum(F.when(inside, F.col(c).cast("double") * F.col(c))) for c in CHANNELS]
    n = F.count_if(inside)
    mean = (sums[0] + sums[1] + sums[2]) / (3 * n)
    var = (squares[0] + squares[1] + squares[2]) / (3 * n) - mean * mean
    gaps = [F.median(F.when(inside, F.col(c))) - F.median(F.when(lit_up, F.col(c))) for c in CHANNELS]
    return px.groupBy(key).agg(
        n.alias("n"), (F.count_if(inside & dark) / n).alias("black"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]).alias("delta")
    )


def accepted(p: Params = DEFAULT, strict: bool = False) -> Column:
    few_black = F.col("black") <= p.max_black
    return few_black if strict else few_black | ((F.col("std") >= p.min_std) & (F.col("delta") <= p.max_delta))


def otsu(values: DataFrame, key: str, value: str) -> DataFrame:
    """The level (0..255) that splits a group's values with the greatest variance between the parts; the least on ties.
    From histograms: at most 256 rows a group, however many values."""
    h = values.groupBy(key, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    c = h.select(key, "v", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    d = (F.col("s0") * F.col("n") - F.col("s") * F.col("n0")).cast("double")
    between = F.when(F.col("n0") < F.col("n"), d * d / (F.col("n0") * (F.col("n") - F.col("n0")))).otherwise(F.lit(0.0))
    return c.withColumn("between", between).groupBy(key).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("level"))


def sobel(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Magnitude of the 3 x 3 gradient of value at (key, y, x), outside counting as the border. By a join of each pixel to its
    neighbours' rows: windows over x within rows, then over y within columns."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    near = lambda c, w, k: F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.col(c))
    a = px.withColumn("dx", near("value", row, -1) - near("value", row, 1)).withColumn("sx", near("value", row, 1) + 2 * F.col("value") + near("value", row, -1))
    a = a.withColumn("gx", near("dx", column, 1) + 2 * F.col("dx") + near("dx", column, -1)).withColumn("gy", near("sx", column, -1) - near("sx", column, 1))
    return a.select(key, "y", "x", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")).alias("magnitude"))


def base_colour(px: DataFrame, *keys: str) -> DataFrame:
    """Medians of the border pixels of each region; the mean of all its pixels where it has none."""
    border = [F.median(F.when(F.col("border"), F.col(c))) for c in CHANNELS]
    return px.groupBy(*keys).agg(*[F.coalesce(m, F.avg(c)).alias(c) for m, c in zip(border, CHANNELS, strict=True)])


def glyph_threshold(px: DataFrame, key: str, scale: int = 3, least: int = 12, share: float = 0.65) -> DataFrame:
    """Text pixels of regions by their distance to the region's own ground (base_colour), scaled and cut to 0..255: at least `least` and `share` of the Otsu level.
    px has a flag `border`. Gives key, level, n, n_glyph and whether their share is so small or large that the whole region is taken."""
    ground = base_colour(px, key).select(key, *[F.col(c).alias(f"base_{c}") for c in CHANNELS])
    gap = [F.col(c) - F.col(f"base_{c}") for c in CHANNELS]
    d = px.join(ground, key).select(key, F.least(F.lit(255), F.floor(F.lit(scale) * F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]))).cast("long").alias("d"))
    glyph = F.col("d") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("level"))
    out = d.join(otsu(d, key, "d"), key).groupBy(key, "level").agg(F.count("*").alias("n"), F.count_if(glyph).alias("n_glyph"))
    part = F.col("n_glyph") / F.col("n")
    return out.withColumn("coarse", (part < 0.015) | (part > 0.68))


def prefill(px: DataFrame, key: str, least: int = 50, grey: int = 80) -> DataFrame:
    """The colour that a hole is filled with first: the medians of the pixels outside it, cut to whole levels, if there are more than `least`; else grey."""
    enough = F.count_if(~F.col("hole")) > least
    return px.groupBy(key).agg(*[F.when(enough, F.median(F.when(~F.col("hole"), F.col(c))).cast("long")).otherwise(F.lit(grey).cast("long")).alias(c) for c in CHANNELS])

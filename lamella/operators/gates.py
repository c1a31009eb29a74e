"""Decisions: what text detections stay, what is drawn, what is repaired how, which attempt counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import decimals, half_even, shortest
from lamella.functions.text import is_single_latin
from lamella.params import DEFAULT, Params


def text_reason(p: Params = DEFAULT) -> Column:
    """Why a detection (text, score, w, h) goes; null if it stays. The first reason counts."""
    unsure = F.col("score") < p.sure_confidence
    return (
        F.when(F.col("score") < p.min_confidence, F.lit("low_conf"))
        .when(is_single_latin(F.col("text")) & unsure, F.lit("single_latin"))
        .when(unsure & (F.col("w") > 0) & (F.col("h") >= F.lit(p.tall_ratio) * F.col("w")), F.lit("vertical_deco"))
    )


def stable_ids(entries: DataFrame, order: list[str], key: str = "image_id") -> DataFrame:
    return entries.withColumn("id", F.format_string("text_%03d", F.row_number().over(Window.partitionBy(key).orderBy(*order))))


def render(in_ids: Column, hit: Column, trusted: Column) -> Column:
    """How a detection is drawn, and why: listed ids need a hit or a trusted plan; otherwise a hit decides."""
    one = lambda how, why, rejected: F.struct(F.lit(how).alias("render"), F.lit(why).cast("string").alias("why"), rejected.alias("rejected"))
    by_id = one("raster", "id", F.lit(False))
    return F.when(in_ids & (hit.isNotNull() | trusted), by_id).when(hit.isNotNull(), one("raster", "bbox", in_ids)).otherwise(one("editable", None, in_ids))


def text_style(h: Column, cjk: Column, coverage: Column, fg_luma: Column, bg_luma: Column) -> Column:
    """size, weight, whether a stroke is dark, stroke width."""
    return F.struct(
        F.greatest(F.lit(8), half_even(h * F.when(cjk, 0.88).otherwise(0.82))).alias("size"),
        F.when(coverage >= 0.17, 700).otherwise(600).alias("weight"),
        (fg_luma >= bg_luma).alias("dark_stroke"),
        F.greatest(F.lit(0), F.least(F.lit(2), half_even(h * F.when(coverage > 0.12, 0.045).otherwise(0.03)))).alias("stroke"),
    )


def dilate_radius(h: Column, single_cjk: Column) -> Column:
    """How far the mask of a text of this height is grown."""
    of = lambda share, low, high: F.greatest(F.lit(low), F.least(F.lit(high), half_even(h * share)))
    return F.when(single_cjk, of(0.16, 3, 8)).otherwise(of(0.09, 2, 6))


def repair_route(mode: Column, hole: Column, policy: str = "auto", p: Params = DEFAULT) -> Column:
    """surface, image-gen, image-fill, too-small or none."""
    generate = F.lit(policy in ("auto", "gen"))
    return (
        F.when((mode == "surface") & (hole > 0), F.lit("surface"))
        .when((mode == "image") & (hole >= p.min_hole), F.when(generate, F.lit("image-gen")).otherwise(F.lit("image-fill")))
        .when((mode == "image") & (hole > 0), F.lit("too-small"))
        .otherwise(F.lit("none"))
    )


def first_accepted(attempts: DataFrame, key: str, order: list[str], flag: str = "accepted") -> DataFrame:
    """The first accepted attempt of each key, how many were made until then, and all made where none was accepted. Attempts after
    an error don't count: an error ends the series."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = attempts.withColumn("k", F.row_number().over(w)).withColumn("failed", F.coalesce(F.max(F.col("error").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    valid = ranked.filter("failed = 0")
    return valid.groupBy(key).agg(F.min(F.when(F.col(flag) & F.col("error").isNull(), F.col("k"))).alias("accepted_at"), F.count("*").alias("valid_attempts")).withColumn("used", F.coalesce("accepted_at", "valid_attempts"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_log(manifest: DataFrame, log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """manifest with the first row of the log for its key."""
    first = log.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")
    return manifest.join(first, key, "left")


def ask_size(w: Column, h: Column, p: Params = DEFAULT) -> Column:
    """The size to ask a provider for: as it is from its least number of pixels on, else scaled up, the height then raised until
    there are enough; null beyond its greatest side."""
    enough, scale = w * h >= p.min_request_pixels, F.sqrt(F.lit(float(p.min_request_pixels)) / (w * h))
    wide = F.when(enough, w).otherwise(F.ceil(w * scale)).cast("long")
    high = F.when(enough, h).otherwise(F.greatest(F.ceil(h * scale), F.ceil(F.lit(p.min_request_pixels) / wide))).cast("long")
    return F.when(F.greatest(wide, high) <= p.max_request_side, F.struct(wide.alias("w"), high.alias("h")))


def fit_size(w: Column, h: Column, low: int = 512, high: int = 4096) -> Column:
    """Width and height scaled into [low, high]; where both can't be had, the longer side is `high`."""
    up = F.when(F.least(w, h) < low, F.lit(float(low)) / F.least(w, h)).otherwise(F.lit(1.0))
    s = F.when(F.greatest(w, h) * up > high, F.lit(float(high)) / F.greatest(w, h)).otherwise(up)
    side = lambda x: F.greatest(F.lit(1).cast("long"), half_even(x * s))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def box_token(x: Column, n: Column) -> Column:
    """A coordinate as a token from 0 to 999."""
    return F.least(F.lit(999), F.greatest(F.lit(0), half_even(x / n * 1000)))


def box_tokens(x0: Column, y0: Column, x1: Column, y1: Column, w: int, h: int, pad: int = 0) -> Column:
    """The four tokens of a box, grown by pad within the canvas; null for a null box."""
    low = lambda v: F.greatest(F.lit(0), v - pad) if pad else v
    top = lambda v, n: F.least(F.lit(n), v + pad) if pad else v
    parts = [box_token(low(x0), F.lit(float(w))), box_token(low(y0), F.lit(float(h))), box_token(top(x1, w), F.lit(float(w))), box_token(top(y1, h), F.lit(float(h)))]
    return F.when(x0.isNotNull(), F.concat_ws(" ", *[x.cast("string") for x in parts]))


def region_prompt(regions: DataFrame, most: int = 12, key: str = "image_id") -> DataFrame:
    """Of each image the tokens (ord, token) of its first regions, as a prompt has them; null tokens are left out, after the count."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("ord", "token"))), 1, most)
    return regions.groupBy(key).agg(F.transform(F.filter(first, lambda r: r.getField("token").isNotNull()), lambda r: F.concat(F.lit("<bbox>"), r.getField("token"), F.lit("</bbox>"))).alias("r")).select(
        key, F.when(F.size("r") > 0, F.array_join("r", " ")).alias("regions")
    )


def cache_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def prompt_block(entries: DataFrame, w: int, h: int, key: str = "image_id") -> DataFrame:
    """The detections of an image as a prompt lists them, in order: id, text on one line, box as rounded parts of the canvas, confidence."""
    box = F.concat(F.lit("["), F.concat_ws(", ", *[shortest(F.col(c) / F.lit(float(max(1, n))), 4) for c, n in (("x0", w), ("y0", h), ("x1", w), ("y1", h))]), F.lit("]"))
    text = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    line = F.concat(F.lit("  "), F.concat_ws(" | ", "id", text, box, decimals(F.coalesce("score", F.lit(0.0)), 2)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ord"), line.alias("line"))))
    head = F.concat(F.lit("\n\nOCR regions ("), F.count("*").cast("string"), F.lit("), format id | text | bbox_norm | conf:\n"))
    return entries.groupBy(key).agg(F.concat(head, F.array_join(F.transform(ordered, lambda x: x.getField("line")), "\n")).alias("block"))


def consensus(matches: DataFrame, p_good: float = 0.85, share: float = 0.6) -> DataFrame:
    """image_id, layer_id, n_good, mean_good of templates that enough others match: at least max(2, share of the others)."""
    good = F.col("value") >= p_good
    out = matches.groupBy("image_id", "layer_id").agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"), F.avg(F.when(good, F.col("value"))).alias("mean_good"))
    return out.filter(F.col("n_good") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("n")))).drop("n")

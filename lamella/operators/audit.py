"""Aggregates of a finished run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import half_even, round_n, shortest
from lamella.operators import masks, raster


def sprite_groups(layers: DataFrame) -> DataFrame:
    """Groups of three or more unrepaired layers of an image that are alike in kind and in size to 16 pixels."""
    k = lambda a: half_even((F.col(f"{a}1") - F.col(f"{a}0")) / 16).alias(f"g{a}")
    return layers.filter("mode = 'none'").groupBy("image_id", "kind", k("x"), k("y")).agg(F.count("*").alias("n")).filter("n >= 3")


def family_consistency(layers: DataFrame) -> DataFrame:
    """Families of three or more with their number of sizes, range of opacity and whether all are unrepaired."""
    return layers.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("w", "h").alias("n_sizes"), F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"), F.bool_and(F.col("mode") == "none").alias("all_none")).filter("n >= 3")


def version_gain(new: DataFrame, old: DataFrame) -> DataFrame:
    """Gain of area of layers in both versions, and percent of the old area to one decimal."""
    j = new.alias("n").join(old.alias("o"), "id")
    gain = F.col("n.area") - F.col("o.area")
    return j.select("id", gain.alias("gain"), round_n(F.lit(100) * gain / F.greatest(F.lit(1), F.col("o.area")), 1).alias("pct"))


def box_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Greatest deviation of a box's four sides."""
    side = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in ("x0", "y0", "x1", "y1")]
    return a.alias("a").join(b.alias("b"), "id").select("id", F.greatest(*side).alias("error"))


def safe_area(images: DataFrame, covered: DataFrame, w: int, h: int, least: int) -> DataFrame:
    """A synthetic row for images whose top band of h rows has more than `least` pixels that no mask covers; covered: image_id, pixels. An image without
    any mask there has the whole band."""
    free = F.lit(w * h) - F.coalesce("pixels", F.lit(0))
    return images.select("image_id").distinct().join(covered, "image_id", "left").filter(free > least).select("image_id", F.lit("status_bar_safe_area").alias("id"), free.alias("pixels"))


def manifest(layers: DataFrame, log: DataFrame, duplicates: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of the export in their order (z, then id): layers that aren't dropped and aren't duplicates, how they were repaired
    (the first row of the log), and which duplicates they stand for (null if none)."""
    kept = layers.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).join(dropped, "id", "left_anti").join(duplicates.select("image_id", F.col("loser").alias("id")), ["image_id", "id"], "left_anti")
    first = log.groupBy("id").agg(F.min_by("method", "ord").alias("method"))
    aka = duplicates.groupBy("image_id", F.col("keeper").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("loser")), ",").alias("aka"))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("z", "id"))
    return kept.join(first, "id", "left").join(aka, ["image_id", "id"], "left").select("image_id", "id", n.alias("position"), "method", "aka")


def lossless(differences: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x) that differ outside the allowed runs, per image that has differences."""
    a, r = differences.alias("a"), allowed.alias("r")
    on = (F.col("a.image_id") == F.col("r.image_id")) & (F.col("a.y") == F.col("r.y")) & (F.col("a.x") >= F.col("r.x0")) & (F.col("a.x") < F.col("r.x1"))
    bad = a.join(r, on, "left_anti").groupBy("image_id").agg(F.count("*").alias("n_bad"))
    return differences.select("image_id").distinct().join(bad, "image_id", "left").select("image_id", F.coalesce("n_bad", F.lit(0).cast("long")).alias("n_bad"))


def self_check(differences: DataFrame, holes: DataFrame, free: DataFrame, w: int, h: int, reach: int = 3) -> DataFrame:
    """Pixels (image_id, y, x) that differ outside the holes (runs with layer_id) grown by reach and outside what is free to differ: the safe area and dropped
    layers (runs image_id, y, x0, x1). A row for each image that has differences."""
    grown = masks.grown(holes, reach, w, h).select("image_id", "y", "x0", "x1")
    return lossless(differences, raster.coalesced(grown.unionByName(free.select("image_id", "y", "x0", "x1")), ("image_id", "y")))


def review_text(manifest: DataFrame, mismatch: DataFrame) -> DataFrame:
    """manifest with what a person should look at: sprites that don't match their template (image_id, id, score to 3 decimals)."""
    text = mismatch.select("image_id", "id", F.concat(F.lit("sprite mismatch score="), shortest(F.col("score"), 3)).alias("review"))
    return manifest.join(text, ["image_id", "id"], "left")


def gain_ranking(gains: DataFrame, key: str = "image_id") -> DataFrame:
    """Of rows (key, ord, id, gain, pct): how many grew, of how many, and the rows of the greatest and the least gain (the first, the last by order on ties)."""
    up, down = F.struct("gain", -F.col("ord")), F.struct("gain", -F.col("ord"))
    return gains.groupBy(key).agg(F.count_if(F.col("gain") > 0).alias("grew"), F.count("*").alias("n"), F.max_by("id", up).alias("most_id"), F.max_by("pct", up).alias("most_pct"), F.min_by("id", down).alias("least_id"), F.min_by("pct", down).alias("least_pct"))


def repair_counters(log: DataFrame, key: str = "image_id") -> DataFrame:
    """How layers were repaired: by surface, by an atlas, by the classical fill."""
    atlas = F.coalesce(F.col("method").endswith("-atlas"), F.lit(False))
    return log.groupBy(key).agg(F.count_if(F.col("mode") == "surface").alias("surface"), F.count_if(atlas).alias("gen"), F.count_if((F.col("mode") == "image") & ~atlas).alias("ns"))


def paid_calls(calls: DataFrame, key: str = "image_id") -> DataFrame:
    """Calls that weren't answered from a cache, and their kinds in order."""
    paid = calls.filter(~F.col("kind").eqNullSafe(F.lit("cache")))
    return paid.groupBy(key).agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))


def timings(steps: DataFrame, key: str = "image_id") -> DataFrame:
    """Steps (key, name, seconds) with their time to hundredths, and a row of their total."""
    each = steps.select(key, "name", round_n(F.col("seconds"), 2).alias("seconds"))
    total = steps.groupBy(key).agg(round_n(F.sum("seconds"), 2).alias("seconds")).select(key, F.lit("total").alias("name"), "seconds")
    return each.unionByName(total)


def plate_statistics(pixels: DataFrame, key: str = "image_id", strong: int = 60) -> DataFrame:
    """Of pixels (key, hole, value, edge, changed) inside and outside the hole: spread, mean edge, share of strong edges, share of black, and how many changed."""
    return pixels.groupBy(key, "hole").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"), F.avg("edge").alias("edge"), F.avg((F.col("edge") > strong).cast("int")).alias("strong"), F.avg((F.col("value") == 0).cast("int")).alias("black"), F.count_if("changed").alias("changed"))


def contact_rows(tiles: DataFrame, per: int = 8, gap: int = 6, key: str = "image_id") -> DataFrame:
    """Tiles (key, ord, w, h) of a contact sheet: rows of `per` in their order, each with its number of tiles, width and height."""
    row = F.floor((F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1) / per)
    return tiles.withColumn("row", row).groupBy(key, "row").agg(F.count("*").alias("n"), (F.sum("w") + gap * (F.count("*") - 1)).alias("w"), F.max("h").alias("h"))


def dropped(case: DataFrame, flags: DataFrame) -> DataFrame:
    """Ids to leave out: those of the case and those of the call, once each."""
    return case.unionByName(flags).distinct()


def foreign_holes(masks_: DataFrame, holes: DataFrame) -> DataFrame:
    """Pixels (image_id, layer_id, pixels) of a layer's box where the hole of another layer is and its own isn't: there its cut shows the original."""
    box = raster.measures(masks_).select("image_id", "layer_id", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    every = raster.coalesced(holes.select("image_id", "y", "x0", "x1"), ("image_id", "y"))
    inside = every.join(box, "image_id").filter("y >= by0 and y < by1").select("image_id", "layer_id", "y", F.greatest("x0", "bx0").alias("x0"), F.least("x1", "bx1").alias("x1")).filter("x1 > x0")
    return masks.less(inside, raster.coalesced(holes)).groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


def newest(folders: DataFrame, key: str = "source") -> DataFrame:
    """The folder (key, path, modified, complete) that was modified last among the complete ones; the later path on ties."""
    return folders.filter("complete").groupBy(key).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def error_summary(errors: DataFrame, key: str) -> DataFrame:
    """Of box errors (key, error): their mean to one decimal, the greatest and their number."""
    return errors.groupBy(key).agg(round_n(F.avg("error"), 1).alias("mean"), F.max("error").alias("most"), F.count("*").alias("n"))


def reason_counts(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """key and a map from reasons to how often they are given; rows without a reason count for nothing."""
    n = rows.filter(F.col(reason).isNotNull()).groupBy(key, reason).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(reason), "n")))).alias("reasons"))

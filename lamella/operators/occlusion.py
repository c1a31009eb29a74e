"""Spatial joins within an image: what lies over what, what repeats what, what contains what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import area, intersection
from lamella.operators import dense
from lamella.params import DEFAULT, Params

#: Side of a tile in pixels. A busy image is dealt out by tiles, so one image is no one task.
TILE = 256


def tiled(boxes: DataFrame) -> DataFrame:
    """A row for each tile that a box touches."""
    tiles = lambda a: F.sequence(F.floor(F.col(f"{a}0") / TILE), F.floor((F.greatest(F.col(f"{a}1"), F.col(f"{a}0") + 1) - 1) / TILE))
    return boxes.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))


def overlapping(a: DataFrame, b: DataFrame, condition: Column, key: str = "image_id") -> DataFrame:
    """Pairs of boxes (aliases a and b) of an image that share pixels and meet the condition. Joined by image and tile; of
    the tiles that both touch, the one with the intersection's corner gives the pair, so each comes once without a distinct."""
    a, b = tiled(a).alias("a"), tiled(b).alias("b")
    corner = (F.floor(F.greatest("a.x0", "b.x0") / TILE) == F.col("a.tx")) & (F.floor(F.greatest("a.y0", "b.y0") / TILE) == F.col("a.ty"))
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    meet = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    return a.join(b, same & meet & corner & condition)


def edges(layers: DataFrame, p: Params = DEFAULT, touch: bool = False) -> DataFrame:
    """Geometric occlusion: image_id, under_id, over_id, pixels of layers with a greater z that share more than so many pixels; with touch,
    also of those whose box, grown by p.touch_reach, has more than p.touch_pixels of the lower one (the mask of a layer being its box: for
    others see touching())."""
    over = F.col("b.z") > F.col("a.z")
    shared = lambda r: F.greatest(F.lit(0), F.least("a.x1", F.col("b.x1") - r) - F.greatest("a.x0", F.col("b.x0") + r)) * F.greatest(F.lit(0), F.least("a.y1", F.col("b.y1") - r) - F.greatest("a.y0", F.col("b.y0") + r))
    if not touch:
        pixels, near, upper = shared(0), shared(0) > p.overlap_pixels, layers
    else:
        r = p.touch_reach
        upper = layers.withColumns({"x0": F.col("x0") - r, "y0": F.col("y0") - r, "x1": F.col("x1") + r, "y1": F.col("y1") + r})
        pixels, near = shared(r), (shared(r) > p.overlap_pixels) | (shared(0) > p.touch_pixels)
    return overlapping(layers, upper, over & near).select(F.col("a.image_id").alias("image_id"), F.col("a.id").alias("under_id"), F.col("b.id").alias("over_id"), pixels.alias("pixels"))


def touching(layers: DataFrame, runs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """image_id, under_id, over_id of layers(image_id, layer_id, z) where the mask (runs or bands) with the greater z, grown by p.touch_reach, has more than
    p.touch_pixels of the lower mask."""
    return dense.with_images(runs, layers, ["layer_id", "z"], dense.touches(p.touch_reach, p.touch_pixels), dense.EDGES)


def with_children(geometric: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges of parents(image_id, parent_id, child_id) joined to the geometric ones, each edge once."""
    kin = parents.select("image_id", F.col("parent_id").alias("under_id"), F.col("child_id").alias("over_id"), F.lit("parent").alias("via"))
    return kin.unionByName(geometric.select("image_id", "under_id", "over_id", F.lit("geometry").alias("via"))).groupBy("image_id", "under_id", "over_id").agg(F.max("via").alias("via"))


def needs_repair(layers: DataFrame, edge: DataFrame) -> DataFrame:
    """Layers with the number of what lies over them, and whether they need repair."""
    n = edge.groupBy("image_id", F.col("under_id").alias("id")).agg(F.count("*").alias("n_over"))
    out = layers.join(n, ["image_id", "id"], "left").withColumn("n_over", F.coalesce("n_over", F.lit(0).cast("long")))
    return out.withColumn("needs_repair", (F.col("n_over") > 0) & (F.col("mode") != "none"))


def duplicates(boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """image_id, loser, keeper: boxes that are nearly the same. The one of the smaller family loses, then of the smaller
    area, then the later; of several keepers the pair that comes last by order counts."""
    fam = boxes.withColumn("n_family", F.count("*").over(Window.partitionBy("image_id", "family")))
    shared = intersection("a.", "b.")
    union = area("a.") + area("b.") - shared
    pairs = overlapping(fam, fam, (F.col("a.ord") < F.col("b.ord")) & (shared >= p.duplicate_pixels) & (shared > F.lit(p.duplicate_iou) * union))
    first_loses = (F.col("a.n_family") < F.col("b.n_family")) | ((F.col("a.n_family") == F.col("b.n_family")) & (area("a.") < area("b.")))
    pick = lambda x, y: F.when(first_loses, F.col(x)).otherwise(F.col(y))
    rows = pairs.select(F.col("a.image_id").alias("image_id"), pick("a.id", "b.id").alias("loser"), pick("b.id", "a.id").alias("keeper"), F.struct(F.col("a.ord"), F.col("b.ord")).alias("at"))
    return rows.groupBy("image_id", "loser").agg(F.max_by("keeper", "at").alias("keeper"))


def contained(edge: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Edges of which half of what lies over is inside what lies under."""
    size = boxes.select("image_id", F.col("id").alias("over_id"), area().alias("over_area"))
    return edge.join(size, ["image_id", "over_id"]).filter(F.col("pixels") >= F.lit(p.containment) * F.col("over_area")).select("image_id", "under_id", "over_id")


def first_hit(entries: DataFrame, logos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Entries with the first logo, by plan order, that covers more than half of them; null if none does."""
    hits = overlapping(entries, logos, intersection("a.", "b.") > F.lit(p.logo_share) * area("a."))
    best = hits.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.id").alias("id")).agg(F.min_by("b.id", "b.ord").alias("hit"))
    return entries.join(best, ["image_id", "id"], "left")


def nearest(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The box that owns each point: of those that contain it the one whose centre is nearest, in single precision, the later on ties."""
    inside = (F.col("p.image_id") == F.col("b.image_id")) & (F.col("p.x") >= F.col("b.x0")) & (F.col("p.x") < F.col("b.x1")) & (F.col("p.y") >= F.col("b.y0")) & (F.col("p.y") < F.col("b.y1"))
    tile = (F.floor(F.col("p.x") / TILE) == F.col("b.tx")) & (F.floor(F.col("p.y") / TILE) == F.col("b.ty"))
    dx, dy = F.col("p.x") - (F.col("b.x0") + F.col("b.x1")) / 2, F.col("p.y") - (F.col("b.y0") + F.col("b.y1")) / 2
    far = F.sqrt(dx * dx + dy * dy).cast("float")
    hit = points.alias("p").join(tiled(boxes).alias("b"), inside & tile)
    return hit.groupBy("p.image_id", "p.x", "p.y").agg(F.max_by("b.id", F.struct(-far, F.col("b.ord"))).alias("owner"))

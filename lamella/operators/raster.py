"""Masks as runs: rows (image_id, layer_id, y, x0, x1), half-open. Everything is relational; no raster is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import dense
from lamella.operators.gates import ask_size
from lamella.params import DEFAULT, Params

KEYS = ("image_id", "layer_id", "y")


def from_boxes(boxes: DataFrame) -> DataFrame:
    """A run for each row of pixels of a box."""
    return boxes.filter("x1 > x0 and y1 > y0").select("image_id", "layer_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")


def bands(boxes: DataFrame, *more: str) -> DataFrame:
    """A box as a band: a run that is the same in all rows from y to y1. For operators that take an image at a time."""
    return boxes.filter("x1 > x0 and y1 > y0").select("image_id", "layer_id", F.col("y0").alias("y"), "y1", "x0", "x1", *more)


def coalesced(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs that touch or overlap become one."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_new", F.when(F.col("x0") <= before, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(*keys, "_k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_k")


def merged(runs: DataFrame) -> DataFrame:
    """coalesced() of runs or bands, an image at a time."""
    return runs.groupBy("image_id").applyInArrow(dense.shape(lambda *m: m), dense.RUNS)


def from_pixels(px: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pixels (keys, x) to runs."""
    island = F.col("x") - F.row_number().over(Window.partitionBy(*keys).orderBy("x"))
    return px.distinct().withColumn("_k", island).groupBy(*keys, "_k").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_k")


def union(runs: DataFrame) -> DataFrame:
    """The union over an image's layers."""
    return coalesced(runs.select("image_id", "y", "x0", "x1"), ("image_id", "y"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, a_id, b_id, pixels of masks that share pixels."""
    a, b = a.alias("a"), b.alias("b")
    on = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    pixels = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    return a.join(b, on).groupBy(F.col("a.image_id").alias("image_id"), F.col("a.layer_id").alias("a_id"), F.col("b.layer_id").alias("b_id")).agg(F.sum(pixels).alias("pixels"))


def dilate(runs: DataFrame, left: int, right: int, up: int, down: int) -> DataFrame:
    """By a rectangle that reaches so far; erosion is the dilation of the complement."""
    grown = runs.select("image_id", "layer_id", F.explode(F.sequence(F.col("y") - up, F.col("y") + down)).alias("y"), (F.col("x0") - left).alias("x0"), (F.col("x1") + right).alias("x1"))
    return coalesced(grown)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without what b (coalesced, image_id, y, x0, x1) covers. Gaps between b's runs are cut out of a's."""
    w = Window.partitionBy("image_id", "y").orderBy("x0")
    gaps = b.select("image_id", "y", F.col("x1").alias("g0"), F.lead("x0").over(w).alias("g1"))
    first = b.groupBy("image_id", "y").agg(F.lit(None).cast("long").alias("g0"), F.min("x0").cast("long").alias("g1"))
    holes = gaps.select("image_id", "y", F.col("g0").cast("long").alias("g0"), F.col("g1").cast("long").alias("g1")).unionByName(first)
    cut = a.join(holes, ["image_id", "y"], "left")
    x0, x1 = F.greatest("x0", F.coalesce("g0", "x0")), F.least("x1", F.coalesce("g1", "x1"))
    return cut.select("image_id", "layer_id", "y", x0.alias("x0"), x1.alias("x1")).filter("x1 > x0")


def clip(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs inside the window (image_id, layer_id, wx0, wy0, wx1, wy1) of their layer."""
    j = runs.join(windows, ["image_id", "layer_id"]).filter("y >= wy0 and y < wy1")
    return j.select(*KEYS, F.greatest("x0", "wx0").alias("x0"), F.least("x1", "wx1").alias("x1")).filter("x1 > x0")


def guarded(runs: DataFrame, windows: DataFrame, least: float = 0.35) -> DataFrame:
    """Clipped runs, but a layer's own where less than this share would be left."""
    cut = clip(runs, windows)
    n = lambda r, name: r.groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0")).alias(name))
    fails = n(runs, "before").join(n(cut, "after"), ["image_id", "layer_id"], "left").filter(F.coalesce("after", F.lit(0)) < F.lit(least) * F.col("before")).select("image_id", "layer_id")
    return cut.join(fails, ["image_id", "layer_id"], "left_anti").unionByName(runs.join(fails, ["image_id", "layer_id"], "left_semi").select(cut.columns))


def measures(runs: DataFrame) -> DataFrame:
    """Area and box of each mask."""
    return runs.groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))


def painted(runs: DataFrame) -> DataFrame:
    """image_id, y, x0, x1, layer_id: the layer that paints each pixel, as runs. runs (or bands) have z and ord: the greatest z, the later in plan order on ties."""
    return runs.groupBy("image_id").applyInArrow(dense.on_top, "image_id long, y long, x0 long, x1 long, layer_id long")


def holes(masks: DataFrame, edges: DataFrame, reach: int = 7) -> DataFrame:
    """What is missing of each layer: what lies over it (edges under_id, over_id), grown by reach, within its mask."""
    over = masks.join(edges.select("image_id", F.col("over_id").alias("layer_id"), "under_id"), ["image_id", "layer_id"]).select("image_id", F.col("under_id").alias("layer_id"), "y", "x0", "x1")
    grown = dilate(over, reach, reach, reach, reach)
    a, b = masks.alias("a"), grown.alias("b")
    on = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.layer_id") == F.col("b.layer_id")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    return a.join(b, on).select("a.image_id", "a.layer_id", "a.y", F.greatest("a.x0", "b.x0").alias("x0"), F.least("a.x1", "b.x1").alias("x1"))


def point_hits(points: DataFrame, runs: DataFrame, w: int, h: int, clamped: bool = True) -> DataFrame:
    """points(image_id, layer_id, px, py, kind) with a flag `hit`: whether the layer's mask has the point. Points outside the
    canvas are moved onto its border, or left out."""
    p = points if not clamped else points.withColumns({"px": F.greatest(F.lit(0), F.least(F.lit(w - 1), "px")), "py": F.greatest(F.lit(0), F.least(F.lit(h - 1), "py"))})
    p = p.filter(F.col("px").between(0, w - 1) & F.col("py").between(0, h - 1)).alias("p")
    r = runs.alias("r")
    on = (F.col("p.image_id") == F.col("r.image_id")) & (F.col("p.layer_id") == F.col("r.layer_id")) & (F.col("p.py") == F.col("r.y")) & (F.col("p.px") >= F.col("r.x0")) & (F.col("p.px") < F.col("r.x1"))
    return p.join(r, on, "left").groupBy("p.image_id", "p.layer_id", "p.kind", "p.px", "p.py").agg(F.bool_or(F.col("r.y").isNotNull()).alias("hit"))


def halves(regions: DataFrame, rounds: int = 4, p: Params = DEFAULT) -> DataFrame:
    """Regions (id, x0, y0, x1, y1) cut in two along their longer side, with an overlap to cross-fade over, until a provider takes their
    size or there have been so many rounds. Each round is a projection; there is no recursion to wait for."""
    out = regions
    for _ in range(rounds):
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        over = F.greatest(F.lit(8), F.least(F.lit(64), F.floor(F.least(w, h) / 8)))
        x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
        mx, my = x0 + F.floor(w / 2), y0 + F.floor(h / 2)
        box = lambda a, b, c, d: F.struct(a.cast("long").alias("x0"), b.cast("long").alias("y0"), c.cast("long").alias("x1"), d.cast("long").alias("y1"))
        across = F.array(box(x0, y0, F.least(x1, mx + over), y1), box(F.greatest(x0, mx - over), y0, x1, y1))
        down = F.array(box(x0, y0, x1, F.least(y1, my + over)), box(x0, F.greatest(y0, my - over), x1, y1))
        parts = F.when(ask_size(w, h, p).isNotNull(), F.array(box(x0, y0, x1, y1))).when(w >= h, across).otherwise(down)
        out = out.select("id", F.explode(parts).alias("b")).select("id", "b.*")
    return out

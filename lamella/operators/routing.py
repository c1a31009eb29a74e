"""Which way a layer, a background or an attempt goes, and what a provider is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.gates import repair_route
from lamella.params import DEFAULT, Params


def hint_points(points: Column, w: int, h: int) -> Column:
    """Normalised points (arrays of two numbers) as pixels: cut toward 0, inside the canvas; none is an empty array."""
    pixel = lambda p, k, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), (F.get(p, F.lit(k)) * n).cast("int")))
    return F.coalesce(F.transform(points, lambda p: F.array(pixel(p, 0, w), pixel(p, 1, h))), F.array().cast("array<array<int>>"))


def trusted(sent: Column, ids: Column) -> Column:
    """Whether a plan was made for exactly these ids, in this order."""
    return F.coalesce(sent == ids, F.lit(False))


def with_corrections(entries: DataFrame, corrections: DataFrame, key: str = "image_id") -> DataFrame:
    """Entries (key, ord, id, x0, y0, x1, y1, text) and the corrections that are 2 pixels wide and high at least, numbered in their order after them."""
    kept = corrections.filter("x1 - x0 >= 2 and y1 - y0 >= 2")
    n = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    named = kept.withColumn("id", F.format_string("corr_%03d", n)).withColumn("render", F.lit("editable_text"))
    return entries.unionByName(named, allowMissingColumns=True)


def all_editable(entries: DataFrame) -> DataFrame:
    """Without a plan everything is drawn as text, for no reason; columns that are not exported go."""
    return entries.withColumn("render", F.lit("editable_text")).withColumn("raster_reason", F.lit(None).cast("string")).drop("glyph", "hard")


def element_order(layers: DataFrame, policy: str = "auto", p: Params = DEFAULT) -> DataFrame:
    """Routes of layers(image_id, id, z, mode, hole, atlas) and the turn of each: by z, then id; all that an atlas repairs are repaired at the turn of the
    first of them."""
    routed = layers.withColumn("route", repair_route(F.col("mode"), F.col("hole"), policy, p)).filter("route not in ('none', 'too-small')")
    turn = routed.withColumn("own", F.row_number().over(Window.partitionBy("image_id").orderBy("z", "id")))
    first = F.min("own").over(Window.partitionBy("image_id", "atlas", F.col("route") == "image-gen"))
    return turn.withColumn("turn", F.when(F.col("route") == "image-gen", first).otherwise(F.col("own"))).drop("own")


def background_route(images: DataFrame, attempts: DataFrame, policy: str = "auto") -> DataFrame:
    """image_id, method, seed: how each background(image_id, mode) is made. attempts: image_id, ord, seed, accepted, error. none is the plate, surface the
    classical fill; a scene is generated (if policy is gen, or auto) by the first accepted attempt before any error, else filled; other policies fill."""
    before = Window.partitionBy("image_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("error").isNotNull().cast("int")).over(before), F.lit(0)) == 1
    good = attempts.withColumn("ended", ended).filter("not ended and accepted and error is null").groupBy("image_id").agg(F.min_by("seed", "ord").alias("seed"))
    j = images.join(good, "image_id", "left")
    wanted = F.lit(policy == "gen") | (F.lit(policy == "auto") & (F.col("mode") == "scene"))
    taken = ~F.col("mode").isin("none", "surface") & wanted & F.col("seed").isNotNull()
    method = F.when(F.col("mode") == "none", "plate").when(F.col("mode") == "surface", "ns-surface").when(taken, "scene").otherwise("ns")
    return j.select("image_id", method.alias("method"), F.when(taken, F.col("seed")).alias("seed"))


def cell_method(accepted: Column, black: Column, pixels: Column, provider: str, p: Params = DEFAULT) -> Column:
    """How an element of an atlas is repaired in the end: an accepted atlas gives it its cell, unless too much of the cell's hole is black."""
    share = F.when(pixels > 0, black / pixels).otherwise(F.lit(0.0))
    return F.when(~accepted, F.lit("ns-fallback")).when(share > p.max_black, F.lit("ns-cellfallback")).otherwise(F.lit(f"{provider}-atlas"))


def reviewed(entries: DataFrame, reviews: DataFrame) -> DataFrame:
    """entries(id, text, score) with what the first good review(id, scale, n, text, score) in order of scale says: one result, another text, no less sure."""
    r = reviews.select("id", "scale", "n", F.col("text").alias("new"), F.col("score").alias("sure"))
    ok = entries.join(r, "id").filter("n = 1 and new <> text and sure >= score").groupBy("id").agg(F.min_by(F.struct("new", "sure", "scale"), "scale").alias("m"))
    j = entries.join(ok, "id", "left")
    return j.select("id", F.coalesce("m.new", "text").alias("text"), F.coalesce("m.sure", "score").alias("score"), F.col("m.scale").alias("reviewed_at"))


def best_template(pool: DataFrame, scores: DataFrame, least: float = 0.85, share: float = 0.6) -> DataFrame:
    """Of each group the template whose size is nearest to the pool's median and that matches the others best.
    pool: group, member, k (the order of candidates), w, h, members (of the group); scores: group, member, k, other, value (null where the template doesn't fit in).
    A template needs a good match with max(2, share of the others) of them; key: size difference to 3 decimals, mean of the good ones to 4, order."""
    from lamella.functions.geometry import round_n

    med = pool.groupBy("group").agg(F.median("w").alias("mw"), F.median("h").alias("mh"))
    good = scores.filter(F.col("other") != F.col("member")).filter(F.col("value") >= least).groupBy("group", "member", "k").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,18)")).alias("sum"))
    good = good.withColumn("mean", F.col("sum").cast("double") / F.col("n"))  # whatever order the rows came in
    j = pool.join(med, "group").join(good, ["group", "member", "k"])
    fits = j.filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * (F.col("members") - 1))))
    size = F.abs(F.col("w") - F.col("mw")) / F.col("mw") + F.abs(F.col("h") - F.col("mh")) / F.col("mh")
    key = F.struct(round_n(size, 3).alias("size"), round_n(-F.col("mean"), 4).alias("mean"), "member", "k")
    return fits.withColumn("key", key).groupBy("group").agg(F.min("key").alias("m"), F.min_by("mean", "key").alias("mean")).select("group", "m.member", "m.k", "mean")


def font_fit(size: Column, stroke: Column, w: Column, h: Column, per_w: Column, per_h: Column, least: int = 6) -> Column:
    """The largest size, up to the wanted one and not below `least`, at which a text of so much width and height per size fits a box with its stroke."""
    fits = F.floor(F.least((w - 2 * stroke) / per_w, (h - 2 * stroke) / per_h))
    return F.greatest(F.least(size, F.lit(least)), F.least(size, fits))


def merged_config(cases: DataFrame, flags: DataFrame, defaults: dict, key: str = "case") -> DataFrame:
    """Settings of each case: what a flag says, else the case, else the default; ids to drop are those of both."""
    f = flags.select(key, *[F.col(c).alias(f"_{c}") for c in (*defaults, "dropped")])
    j = cases.join(f, key, "left")
    none = F.array().cast("array<string>")
    chosen = [F.coalesce(f"_{c}", c, F.lit(v)).alias(c) for c, v in defaults.items()]
    return j.select(key, *chosen, F.array_sort(F.array_union(F.coalesce("dropped", none), F.coalesce("_dropped", none))).alias("dropped"))


#: Providers by name: whether they take a mask, how often they are asked, and the size they accept.
PROVIDERS: dict[str, dict] = {}


def provider(name: str, masks: bool, attempts: int, size=None):
    """Registers a provider's fill(batches) for mapInArrow under a name."""

    def register(fill):
        PROVIDERS[name] = {"masks": masks, "attempts": attempts, "size": size, "fill": fill}
        return fill

    return register


def get_provider(name: str) -> dict:
    if name not in PROVIDERS:
        raise RuntimeError(f"unknown provider {name!r}; choose from {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def run_steps(df: DataFrame, steps: list) -> tuple[DataFrame, list[tuple[str, float]]]:
    """(name, function) steps applied one after the other, as DataFrame.transform does; and the seconds that planning each of them took, with
    their total. Work is done when the result is read, and is timed there."""
    import time

    times, began = [], time.time()
    for name, step in steps:
        at = time.time()
        df = df.transform(step)
        times.append((name, round(time.time() - at, 2)))
    return df, [*times, ("total", round(time.time() - began, 2))]

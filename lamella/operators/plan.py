"""Normalisation of layer plans: rows of queries to rows of instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.sources.tables import staged

#: Fixed values.
KIND, ROLE, MODES = "icon", "foreground", ("image", "surface", "none")


def or_default(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def normalise(q: DataFrame) -> DataFrame:
    """Defaults for empty fields, known repair modes only, a castable z, hints without nulls (where there is such a column)."""
    out = q.withColumns(
        {
            "kind": or_default(F.col("kind"), KIND),
            "role": or_default(F.col("role"), ROLE),
            "mode": F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise(F.lit("none")),
            "z": F.coalesce(F.col("z").try_cast("int"), F.lit(0)),
        }
    )
    return out.withColumn("hints", F.filter("hints", lambda h: h.isNotNull())) if "hints" in q.columns else out


def to_pixels(q: DataFrame, w: Column, h: Column) -> DataFrame:
    """Normalised boxes nx0, ny0, nx1, ny1 to pixels: cut toward 0, ends in order, inside the canvas; none is the canvas."""
    missing = F.col("nx0").isNull() | F.col("ny0").isNull() | F.col("nx1").isNull() | F.col("ny1").isNull()
    out = {}
    for a, n in (("x", w), ("y", h)):
        p, q_ = (F.col(f"n{a}0") * n).cast("int"), (F.col(f"n{a}1") * n).cast("int")
        out[f"{a}0"] = F.when(missing, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(p, q_, n - 1)))
        out[f"{a}1"] = F.when(missing, n - 1).otherwise(F.greatest(F.lit(1), F.least(F.greatest(p, q_), n - 1)))
    return q.withColumns(out)


def expand(q: DataFrame, hints: str = "hints") -> DataFrame:
    """A row for each hint; queries without hints go. The id gets _h and its number where there are several."""
    n = F.size(hints)
    rows = q.withColumn("instance_count", n).select("*", F.posexplode(hints).alias("instance_index", "hint")).drop(hints)
    return rows.withColumn("query_id", F.col("id")).withColumn("id", F.when(F.col("instance_count") > 1, F.concat("id", F.lit("_h"), (F.col("instance_index") + 1).cast("string"))).otherwise(F.col("id")))


def unique_ids(q: DataFrame, order: list[str], key: str = "image_id") -> DataFrame:
    """The n-th repeat of an id within an image gets __n."""
    n = F.row_number().over(Window.partitionBy(key, "id").orderBy(*order)) - 1
    return q.withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 0, F.concat("id", F.lit("__"), F.col("_n").cast("string"))).otherwise(F.col("id"))).drop("_n")


def corrections(c: DataFrame) -> DataFrame:
    """Text corrections as boxes: less than 2 pixels wide or high, so inverted ones too, go; no confidence counts as 0.5."""
    return c.filter("x1 - x0 >= 2 and y1 - y0 >= 2").withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)))


def children(c: DataFrame, parent: str = "parent_query_id", child: str = "id", order: str = "ord") -> DataFrame:
    """parent, its children in order."""
    return c.filter(F.col(parent).isNotNull()).groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, child))), lambda x: x.getField(child)).alias("children"))


def depths(edges: DataFrame) -> DataFrame:
    """node, depth, root of every node of edges(node, parent) that a root (parent null) leads to; nodes on cycles, below them or below an unknown parent have
    no row. Pointers are doubled: a join a round, as many rounds as the depth has binary digits, whatever the depth."""
    now = staged(edges.select("node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("int").alias("depth"), F.col("parent").isNull().alias("top")), "depths")
    left = None
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("top").alias("at_top"))
        now = staged(now.join(up, "root").select("node", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("at_top").alias("top")), "depths")
        n = now.filter("not top").count()
        if n == 0 or n == left:
            return now.filter("top").select("node", "depth", "root")
        left = n


def preferred(sources: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of several sources for a key the first by precedence."""
    return sources.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def crops(boxes: DataFrame, pad: int, w: int, h: int) -> DataFrame:
    """boxes with a, b, c, d: the box grown by pad, within the canvas."""
    return boxes.withColumns({"a": F.greatest(F.lit(0), F.col("x0") - pad), "b": F.greatest(F.lit(0), F.col("y0") - pad), "c": F.least(F.lit(w), F.col("x1") + pad), "d": F.least(F.lit(h), F.col("y1") + pad)})


def resolved(wanted: DataFrame, plans: DataFrame, fallbacks: DataFrame, key: str) -> DataFrame:
    """key, source ('plan', 'fallback' or 'none') and is_fallback of what is wanted; plans and fallbacks list the keys they have."""
    j = wanted.join(plans.select(key).distinct().withColumn("_p", F.lit("plan")), key, "left").join(fallbacks.select(key).distinct().withColumn("_f", F.lit("fallback")), key, "left")
    return j.select(key, F.coalesce("_p", "_f", F.lit("none")).alias("source"), (F.col("_p").isNull() & F.col("_f").isNotNull()).alias("is_fallback"))

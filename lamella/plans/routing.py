"""Queries of planning and repair: points, corrections, routes, attempts, templates, fonts, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import geometry as geo
from lamella.operators import gates, plan, routing
from lamella.plans.registry import query
from lamella.plans.views import LAYERS, TEXTS, H, W, layers, texts
from lamella.sources.tables import table

S = SparkSession

_PX = "list_transform({p}, lambda v: [least({w} - 1, greatest(0, trunc(v[1] * {w})::INT)), least({h} - 1, greatest(0, trunc(v[2] * {h})::INT))])"


@query(f"""WITH {LAYERS}, P AS (SELECT image_id, ord, CASE q % 3 WHEN 0 THEN [] WHEN 1 THEN [[x0 / 1000.0::DOUBLE, y0 / 2000.0::DOUBLE]] ELSE [[(x0 - 100) / 700.0::DOUBLE, y0 / 1500.0::DOUBLE], [x1 / 1100.0::DOUBLE, y1 / 2100.0::DOUBLE]] END AS p FROM L)
    SELECT image_id, ord, array_to_string(list_transform({_PX.format(p="p", w=W, h=H)}, lambda v: v[1]::VARCHAR || ',' || v[2]::VARCHAR), ' ') AS points FROM P""")
def hint_points(spark: S, sf: str) -> DataFrame:
    """Normalised points to pixels, some of them beyond the canvas."""
    x, q = layers(spark, sf), F.col("q") % 3
    pair = lambda a, b: F.array(a, b)
    one = F.array(pair(F.col("x0") / 1000.0, F.col("y0") / 2000.0))
    two = F.array(pair((F.col("x0") - 100) / 700.0, F.col("y0") / 1500.0), pair(F.col("x1") / 1100.0, F.col("y1") / 2100.0))
    points = routing.hint_points(F.when(q == 1, one).when(q == 2, two), W, H)
    return x.select("image_id", "ord", F.array_join(F.transform(points, lambda v: F.concat_ws(",", F.get(v, F.lit(0)).cast("string"), F.get(v, F.lit(1)).cast("string"))), " ").alias("points"))


@query(f"""WITH {LAYERS}, I AS (SELECT image_id, list(id ORDER BY ord) AS ids FROM L WHERE z < 3 GROUP BY 1), P AS (SELECT image_id, list(id ORDER BY ord) AS sent FROM L WHERE z < 3 AND (image_id % 3 <> 0 OR q > 10) AND image_id % 5 <> 0 GROUP BY 1)
    SELECT image_id, coalesce(sent = ids, false) AS trusted FROM I LEFT JOIN P USING (image_id)""")
def plan_trusted(spark: S, sf: str) -> DataFrame:
    """A plan is trusted if the ids that it was made for are this run's, in order; without a plan nothing is."""
    x = layers(spark, sf).filter("z < 3")
    listed = lambda df, name: df.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda r: r.getField("id")).alias(name))
    sent = x.filter("(image_id % 3 <> 0 or q > 10) and image_id % 5 <> 0")
    return listed(x, "ids").join(listed(sent, "sent"), "image_id", "left").select("image_id", routing.trusted(F.col("sent"), F.col("ids")).alias("trusted"))


@query(f"""WITH {LAYERS}, C AS (SELECT image_id, ord, x0, y0, x1 - q * 4 AS x1, y1 FROM L WHERE q % 4 = 0), K AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS n FROM C WHERE x1 - x0 >= 2 AND y1 - y0 >= 2)
    SELECT image_id, id, NULL AS render, x1 - x0 AS w FROM L WHERE q % 4 = 1 UNION ALL SELECT image_id, printf('corr_%03d', n), 'editable_text', x1 - x0 FROM K""")
def entries_with_corrections(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).select("image_id", "ord", "id", "q", "x0", "y0", "x1", "y1")
    fixes = x.filter("q % 4 = 0").withColumn("x1", F.col("x1") - F.col("q") * 4).drop("id")
    return routing.with_corrections(x.filter("q % 4 = 1"), fixes).select("image_id", "id", "render", (F.col("x1") - F.col("x0")).alias("w"))


@query(f"WITH {TEXTS} SELECT image_id, ord, 'editable_text' AS render, NULL::VARCHAR AS raster_reason FROM T")
def mark_all_editable(spark: S, sf: str) -> DataFrame:
    e = texts(spark, sf).select("image_id", "ord", F.lit("raster_asset").alias("render"), F.lit("x").alias("glyph"), F.lit("y").alias("hard"))
    return routing.all_editable(e)


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, id, z, mode, q * 3 - 40 AS hole, ord % 2 AS atlas FROM L), R AS (SELECT *, CASE WHEN mode = 'surface' AND hole > 0 THEN 'surface' WHEN mode = 'image' AND hole >= 30 THEN 'image-gen' END AS route FROM X),
    O AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY z, id) AS own FROM R WHERE route IS NOT NULL), G AS (SELECT image_id, atlas, min(own) AS first FROM O WHERE route = 'image-gen' GROUP BY ALL)
    SELECT O.image_id, id, route, CASE WHEN route = 'image-gen' THEN first ELSE own END AS turn FROM O LEFT JOIN G ON G.image_id = O.image_id AND G.atlas = O.atlas""")
def element_order(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).select("image_id", "id", "z", "mode", (F.col("q") * 3 - 40).alias("hole"), (F.col("ord") % 2).alias("atlas"))
    return routing.element_order(x).select("image_id", "id", "route", "turn")


@query("""WITH I AS (SELECT c_custkey AS image_id, CASE c_nationkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'surface' ELSE 'scene' END AS mode FROM customer),
    A AS (SELECT o_custkey AS image_id, o_orderkey AS ord, 11 + o_orderkey % 3 AS seed, o_orderkey % 4 = 0 AS accepted, o_orderkey % 9 = 4 AS failed FROM orders),
    F AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY image_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS errors FROM A), G AS (SELECT image_id, arg_min(seed, ord) AS seed FROM F WHERE errors = 0 AND accepted GROUP BY 1)
    SELECT image_id, CASE WHEN mode = 'none' THEN 'plate' WHEN mode = 'surface' THEN 'ns-surface' WHEN seed IS NOT NULL THEN 'scene' ELSE 'ns' END AS method, CASE WHEN mode = 'scene' THEN seed END AS seed FROM I LEFT JOIN G USING (image_id)""")
def background_route(spark: S, sf: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    images = table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.when(n == 0, "none").when(n == 1, "surface").otherwise("scene").alias("mode"))
    k = F.col("o_orderkey")
    tries = table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"), k.alias("ord"), (11 + k % 3).alias("seed"), (k % 4 == 0).alias("accepted"), F.when(k % 9 == 4, "down").alias("error"))
    return routing.background_route(images, tries)


@query(f"""WITH {LAYERS} SELECT id, CASE WHEN image_id % 4 = 0 THEN 'ns-fallback' WHEN q > 0 AND (q * q % 11) / (100.0::DOUBLE + q) > 0.02 THEN 'ns-cellfallback' ELSE 'x-atlas' END AS method FROM L""")
def cell_salvage(spark: S, sf: str) -> DataFrame:
    q = F.col("q")
    return layers(spark, sf).select("id", routing.cell_method(F.col("image_id") % 4 != 0, q * q % 11, 100 + q, "x").alias("method"))


@query("""WITH E AS (SELECT o_orderkey AS id, (100 + o_custkey % 900)::VARCHAR AS text, (o_orderkey % 10) / 10.0::DOUBLE AS score FROM orders), R AS (SELECT l_orderkey AS id, l_linenumber AS scale, 1 + l_suppkey % 2 AS n, (100 + l_partkey % 900)::VARCHAR AS text, min(l_quantity::INT % 10) AS k FROM lineitem GROUP BY ALL),
    B AS (SELECT id, min((scale, n, R.text, k / 10.0::DOUBLE)) AS m FROM R JOIN E USING (id) WHERE n = 1 AND R.text <> E.text AND k / 10.0::DOUBLE >= score GROUP BY 1)
    SELECT id, coalesce(m[3], text) AS text, coalesce(m[4], score) AS score, m[1] AS reviewed_at FROM E LEFT JOIN B USING (id)""")
def digit_review(spark: S, sf: str) -> DataFrame:
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    e = o.select(F.col("o_orderkey").alias("id"), (100 + F.col("o_custkey") % 900).cast("string").alias("text"), (F.col("o_orderkey") % 10 / 10.0).alias("score"))
    r = l.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), (1 + F.col("l_suppkey") % 2).alias("n"), (100 + F.col("l_partkey") % 900).cast("string").alias("text")).agg((F.min(F.col("l_quantity").cast("int") % 10) / 10.0).alias("score"))
    r = r.withColumn("scale", F.struct("at", "n", "text", "score"))  # several reviews at a scale: the least of them first
    return routing.reviewed(e, r).select("id", "text", "score", F.col("reviewed_at.at").alias("reviewed_at"))


@query(f"""WITH {LAYERS}, G AS (SELECT image_id, kind AS grp, ord AS member, x1 - x0 AS w, y1 - y0 AS h, q, count(*) OVER (PARTITION BY image_id, kind) AS members FROM L WHERE mode = 'none'), M AS (SELECT image_id, grp, median(w)::DOUBLE AS mw, median(h)::DOUBLE AS mh FROM G GROUP BY ALL),
    SC AS (SELECT a.image_id, a.grp, a.member, b.member AS other, CASE WHEN (a.q + b.q) % 5 > 0 THEN (80 + (a.q * b.q) % 20) / 100.0::DOUBLE END AS value FROM G a JOIN G b ON a.image_id = b.image_id AND a.grp = b.grp AND a.member <> b.member),
    GD AS (SELECT image_id, grp, member, count(*) AS n, (sum(round(value * 100)::BIGINT) / 100.0::DOUBLE) / count(*) AS mean FROM SC WHERE value >= 0.85 GROUP BY ALL),
    F AS (SELECT G.image_id, G.grp, member, mean, printf('%.3f', abs(w - mw) / mw + abs(h - mh) / mh)::DOUBLE AS size, round(-mean * 10000) AS nm FROM G JOIN M USING (image_id, grp) JOIN GD USING (image_id, grp, member) WHERE n >= greatest(2, ceil(0.6::DOUBLE * (members - 1))))
    SELECT image_id, grp AS kind, member FROM F QUALIFY row_number() OVER (PARTITION BY image_id, grp ORDER BY size, nm, member) = 1""")
def best_template(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).filter("mode = 'none'")
    group = F.struct("image_id", "kind").alias("group")
    g = x.select(group, F.col("ord").alias("member"), F.lit(0).alias("k"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "q")
    pool = g.join(g.groupBy("group").agg(F.count("*").alias("members")), "group")
    a, b = g.alias("a"), g.alias("b")
    value = F.when((F.col("a.q") + F.col("b.q")) % 5 > 0, (80 + F.col("a.q") * F.col("b.q") % 20) / 100.0)
    scores = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.member") != F.col("b.member"))).select("a.group", "a.member", "a.k", F.col("b.member").alias("other"), value.alias("value"))
    return routing.best_template(pool, scores).select("group.image_id", "group.kind", "member")


@query(f"""WITH {LAYERS}, X AS (SELECT id, 6 + q % 40 AS start, q % 3 AS sw, x1 - x0 AS w, y1 - y0 AS h, 1 + q % 5 AS pw FROM L)
    SELECT id, coalesce((SELECT max(s) FROM range(6, 47) t(s) WHERE s <= start AND s * pw + 2 * sw <= w AND s * 1.25::DOUBLE + 2 * sw <= h), 6) AS size FROM X""")
def font_fit(spark: S, sf: str) -> DataFrame:
    x, q = layers(spark, sf), F.col("q")
    size = routing.font_fit(6 + q % 40, q % 3, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (1 + q % 5).cast("double"), F.lit(1.25))
    return x.select("id", size.alias("size"))


@query(f"""WITH {LAYERS}, X AS (SELECT id, (x1 - x0) * (1 + q % 23) AS w, (y1 - y0) * (1 + q % 31) AS h FROM L), U AS (SELECT *, CASE WHEN least(w, h) < 512 THEN 512 / least(w, h)::DOUBLE ELSE 1.0 END AS u FROM X), F AS (SELECT *, CASE WHEN greatest(w, h) * u > 4096 THEN 4096 / greatest(w, h)::DOUBLE ELSE u END AS s FROM U)
    SELECT id, greatest(1, round_even(w * s, 0)::BIGINT) AS w, greatest(1, round_even(h * s, 0)::BIGINT) AS h FROM F""")
def provider_fit(spark: S, sf: str) -> DataFrame:
    size = gates.fit_size((F.col("x1") - F.col("x0")) * (1 + F.col("q") % 23), (F.col("y1") - F.col("y0")) * (1 + F.col("q") % 31))
    return layers(spark, sf).select("id", size.alias("s")).select("id", "s.w", "s.h")


@query("""SELECT c_custkey AS "case", coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'gen' END, CASE WHEN c_custkey % 3 = 0 THEN 'ns' END, 'auto') AS repair, coalesce(o_orderkey % 5, 120) AS safe,
    array_to_string(list_sort(list_distinct(CASE WHEN c_custkey % 2 = 0 THEN ['a', 'c'] ELSE [] END || CASE WHEN o_orderkey % 3 = 0 THEN ['b', 'a'] ELSE [] END)), ',') AS dropped FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def merged_config(spark: S, sf: str) -> DataFrame:
    """Flag before case before default; ids to drop from both."""
    key = F.col("c_custkey")
    cases = table(spark, sf, "customer").select(key.alias("case"), F.when(key % 3 == 0, "ns").alias("repair"), F.lit(None).cast("long").alias("safe"), F.when(key % 2 == 0, F.array(F.lit("a"), F.lit("c"))).alias("dropped"))
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case")).agg(F.max("o_orderkey").alias("k"))
    flags = last.select("case", F.when(F.col("k") % 2 == 0, "gen").alias("repair"), (F.col("k") % 5).alias("safe"), F.when(F.col("k") % 3 == 0, F.array(F.lit("b"), F.lit("a"))).alias("dropped"))
    out = routing.merged_config(cases, flags, {"repair": "auto", "safe": 120})
    return out.withColumn("dropped", F.array_join("dropped", ","))


@query(f"""WITH {LAYERS}, M AS (SELECT image_id, id, mode, hole, greatest(0, x0 - 10) AS a, greatest(0, y0 - 10) AS b, least({W}, x1 + 10) AS c, least({H}, y1 + 10) AS d, (x1 - x0) * (y1 - y0) - hole AS ref FROM (SELECT *, q * q AS hole FROM L)) SELECT image_id, id, a, b, c, d, ref >= 50 AS prefilled FROM M WHERE mode = 'image' AND hole > 0""")
def atlas_items(spark: S, sf: str) -> DataFrame:
    """Crops of elements for an atlas, and whether their own material can be measured."""
    x = layers(spark, sf).withColumn("hole", F.col("q") * F.col("q")).filter("mode = 'image' and hole > 0")
    return plan.crops(x, 10, W, H).select("image_id", "id", "a", "b", "c", "d", (geo.area() - F.col("hole") >= 50).alias("prefilled"))


@query("""WITH I AS (SELECT c_custkey AS stem FROM customer), P AS (SELECT DISTINCT o_custkey AS stem, 'plan' AS source FROM orders WHERE o_orderstatus = 'F'), F AS (SELECT DISTINCT o_custkey AS stem, 'fallback' AS source FROM orders WHERE o_orderstatus = 'O')
    SELECT stem, coalesce(P.source, F.source, 'none') AS source, P.source IS NULL AND F.source IS NOT NULL AS is_fallback FROM I LEFT JOIN P USING (stem) LEFT JOIN F USING (stem)""")
def resolved_plan(spark: S, sf: str) -> DataFrame:
    """The cached plan of each source, else the fallback one."""
    o = table(spark, sf, "orders")
    of = lambda status: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("stem")).distinct()
    return plan.resolved(table(spark, sf, "customer").select(F.col("c_custkey").alias("stem")), of("F"), of("O"), "stem")

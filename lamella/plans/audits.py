"""Queries of the audit: checks, rankings, counters, statistics and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import geometry as geo
from lamella.functions.text import has_cjk
from lamella.operators import audit, gates, masks, raster, stats
from lamella.plans.registry import query
from lamella.plans.views import ATTEMPTS, LAYERS, PIXELS, SMALL, SMALL_H, SMALL_W, TEXTS, attempts, layers, pixels, small, texts
from lamella.sources.tables import table

S = SparkSession
_AT = "printf('%.4f', {x})::DOUBLE"


def four(c: str) -> F.Column:
    return geo.round_n(F.col(c), 4).alias(c)


@query(f"""WITH {SMALL}, D AS (SELECT DISTINCT image_id, l_suppkey % 95 AS y, l_partkey % 90 + 5 AS x FROM L), A AS (SELECT image_id, greatest(0, x0 - 3) AS x0, least({SMALL_W}, x1 + 3) AS x1, greatest(0, y0 - 3) AS y0, least({SMALL_H}, y1 + 3) AS y1 FROM S WHERE mode = 'image' AND ord % 4 = 0 UNION ALL SELECT image_id, x0, x1, y0, y1 FROM S WHERE ord % 7 = 0 UNION ALL SELECT DISTINCT image_id, 0, {SMALL_W}, 0, 12 FROM S)
    SELECT D.image_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM A WHERE A.image_id = D.image_id AND D.x >= x0 AND D.x < x1 AND D.y >= y0 AND D.y < y1)) AS n_bad FROM D GROUP BY 1""")
def self_check(spark: S, sf: str) -> DataFrame:
    """Differences outside the grown holes, the safe area (12 rows) and dropped layers."""
    x = layers(spark, sf)
    s = small(x)
    differ = x.select("image_id", (F.col("l_suppkey") % 95).alias("y"), (F.col("l_partkey") % 90 + 5).alias("x")).distinct()
    holes = raster.from_boxes(s.filter("mode = 'image' and ord % 4 = 0"))
    safe = s.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).selectExpr("image_id", "y", "0L AS x0", f"{SMALL_W}L AS x1")
    free = raster.from_boxes(s.filter("ord % 7 = 0")).select("image_id", "y", "x0", "x1").unionByName(safe)
    return audit.self_check(differ, holes, free, SMALL_W, SMALL_H)


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, id, q % 100 / 117.0::DOUBLE AS score FROM L WHERE q % 4 = 0) SELECT L.image_id, L.id, L.z, 'sprite mismatch score=' || regexp_replace(printf('%.3f', score), '(\\.\\d+?)0+$', '\\1') AS review FROM L LEFT JOIN X USING (image_id, id)""")
def manifest_review(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    mismatch = x.filter("q % 4 = 0").select("image_id", "id", (F.col("q") % 100 / 117.0).alias("score"))
    return audit.review_text(x.select("image_id", "id", "z"), mismatch)


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, ord, id, (x1 - x0) * (y1 - y0) AS new, (x1 - x0 + q % 7 - 3) * (y1 - y0) AS old FROM L), G AS (SELECT *, new - old AS gain, printf('%.1f', 100 * (new - old) / greatest(1, old)::DOUBLE)::DOUBLE AS pct FROM X),
    R AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gain DESC, ord) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM G)
    SELECT image_id, count(*) FILTER (gain > 0) AS grew, count(*) AS n, max(id) FILTER (k = 1) AS most_id, max(pct) FILTER (k = 1) AS most_pct, max(id) FILTER (k = n) AS least_id, max(pct) FILTER (k = n) AS least_pct FROM R GROUP BY 1""")
def gain_ranking(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    old = x.select("id", "image_id", "ord", ((F.col("x1") - F.col("x0") + F.col("q") % 7 - 3) * (F.col("y1") - F.col("y0"))).alias("area"))
    return audit.gain_ranking(audit.version_gain(x.select("id", geo.area().alias("area")), old).join(old.select("id", "image_id", "ord"), "id"))


_LOG = "G AS (SELECT image_id, mode, CASE WHEN mode = 'surface' THEN 'surface-fill' WHEN mode = 'image' AND q % 3 = 0 THEN 'a-atlas' WHEN mode = 'image' AND q % 3 = 1 THEN 'ns-cellfallback' WHEN mode = 'image' THEN NULL END AS method FROM L WHERE mode <> 'none')"


@query(f"WITH {LAYERS}, {_LOG} SELECT image_id, count(*) FILTER (mode = 'surface') AS surface, count(*) FILTER (method LIKE '%-atlas') AS gen, count(*) FILTER (mode = 'image' AND (method IS NULL OR method NOT LIKE '%-atlas')) AS ns FROM G GROUP BY 1")
def repair_counters(spark: S, sf: str) -> DataFrame:
    q = F.col("q") % 3
    method = F.when(F.col("mode") == "surface", "surface-fill").when(q == 0, "a-atlas").when(q == 1, "ns-cellfallback")
    return audit.repair_counters(layers(spark, sf).filter("mode <> 'none'").select("image_id", "mode", method.alias("method")))


@query(f"WITH {ATTEMPTS}, C AS (SELECT key, CASE WHEN kind = 'view' THEN 'cache' WHEN kind = 'click' THEN NULL ELSE kind END AS kind FROM A) SELECT key, count(*) AS calls, coalesce(string_agg(DISTINCT kind, ', ' ORDER BY kind), '') AS kinds FROM C WHERE kind IS DISTINCT FROM 'cache' GROUP BY 1")
def paid_calls(spark: S, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "view", "cache").when(F.col("kind") != "click", F.col("kind"))
    return audit.paid_calls(attempts(spark, sf).select("key", kind.alias("kind")), "key")


@query(f"""WITH {ATTEMPTS}, X AS (SELECT key, kind || '_' || event_id::VARCHAR AS name, round(seconds * 64)::BIGINT / 64.0::DOUBLE AS seconds FROM A)
    SELECT key, name, printf('%.2f', seconds)::DOUBLE AS seconds FROM X UNION ALL SELECT key, 'total', printf('%.2f', sum(seconds))::DOUBLE FROM X GROUP BY 1""")
def step_timings(spark: S, sf: str) -> DataFrame:
    a = attempts(spark, sf).select("key", F.concat_ws("_", "kind", F.col("event_id").cast("string")).alias("name"), (F.round(F.col("seconds") * 64) / 64).alias("seconds"))
    return audit.timings(a, "key")


_PLATE = f"""{SMALL}, V AS (SELECT image_id, l_suppkey % 30 AS y, l_partkey % 30 AS x, max(q) AS value FROM L GROUP BY ALL), D AS (SELECT *, coalesce(lead(value) OVER r, value) - coalesce(lag(value) OVER r, value) AS dx, coalesce(lag(value) OVER r, value) + 2 * value + coalesce(lead(value) OVER r, value) AS sx FROM V WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
    E AS (SELECT image_id, y, x, value, coalesce(lag(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, dx) AS gx, coalesce(lead(sx) OVER c, sx) - coalesce(lag(sx) OVER c, sx) AS gy FROM D WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
    M AS (SELECT *, sqrt((gx * gx + gy * gy)::DOUBLE) AS edge, (x + y) % 3 = 0 AS hole FROM E)"""


@query(f"""WITH {_PLATE} SELECT image_id, hole, count(*) AS n, {_AT.format(x="stddev_pop(value)")} AS std, {_AT.format(x="avg(edge)")} AS edge, {_AT.format(x="avg((edge > 60)::INT)")} AS strong, {_AT.format(x="avg((value % 5 = 0)::INT)")} AS black, count(*) FILTER (value % 7 = 0) AS changed FROM M GROUP BY ALL""")
def plate_statistics(spark: S, sf: str) -> DataFrame:
    """Inside and outside the hole; every fifth value counts as black."""
    v = layers(spark, sf).groupBy("image_id", (F.col("l_suppkey") % 30).alias("y"), (F.col("l_partkey") % 30).alias("x")).agg(F.max("q").alias("value"))
    px = stats.sobel(v).withColumnRenamed("magnitude", "edge").join(v, ["image_id", "y", "x"]).withColumn("hole", (F.col("x") + F.col("y")) % 3 == 0).withColumn("changed", F.col("value") % 7 == 0)
    shown = px.withColumn("black", F.when(F.col("value") % 5 == 0, 0).otherwise(F.col("value")))
    a = audit.plate_statistics(px).drop("black")
    b = audit.plate_statistics(shown.withColumn("value", F.col("black"))).select("image_id", "hole", "black")
    return a.join(b, ["image_id", "hole"]).select("image_id", "hole", "n", four("std"), four("edge"), four("strong"), four("black"), "changed")


@query(f"WITH {LAYERS}, X AS (SELECT image_id, 150 AS w, 20 + y1 - y0 AS h, (row_number() OVER (PARTITION BY image_id ORDER BY z, ord) - 1) // 8 AS row FROM L) SELECT image_id, row, count(*) AS n, sum(w)::BIGINT + 6 * (count(*) - 1) AS w, max(h) AS h FROM X GROUP BY ALL")
def contact_rows(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    return audit.contact_rows(x.select("image_id", F.struct("z", "ord").alias("ord"), F.lit(150).cast("long").alias("w"), (20 + F.col("y1") - F.col("y0")).alias("h")))


@query("SELECT o_orderpriority AS id FROM orders UNION SELECT c_mktsegment FROM customer")
def dropped_union(spark: S, sf: str) -> DataFrame:
    return audit.dropped(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id")), table(spark, sf, "customer").select(F.col("c_mktsegment").alias("id")))


@query(f"""WITH {SMALL}, H AS (SELECT image_id, layer_id, y, unnest(range(x0, x1 - 1)) AS x FROM R WHERE ord % 5 = 0 AND x1 - x0 > 1), U AS (SELECT DISTINCT image_id, y, x FROM H)
    SELECT S.image_id, S.layer_id, count(*) AS pixels FROM S JOIN U ON U.image_id = S.image_id AND U.y >= y0 AND U.y < y1 AND U.x >= x0 AND U.x < x1 WHERE NOT EXISTS (SELECT 1 FROM H WHERE H.image_id = S.image_id AND H.layer_id = S.layer_id AND H.y = U.y AND H.x = U.x) GROUP BY ALL""")
def foreign_holes(spark: S, sf: str) -> DataFrame:
    s = small(layers(spark, sf))
    return audit.foreign_holes(raster.from_boxes(s), raster.from_boxes(s.filter("ord % 5 = 0 and x1 - x0 > 1").withColumn("x1", F.col("x1") - 1)))


@query("SELECT o_custkey AS source, arg_max('out/' || o_orderkey::VARCHAR, (o_orderdate, 'out/' || o_orderkey::VARCHAR)) AS path FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def newest_output(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return audit.newest(o.select(F.col("o_custkey").alias("source"), F.concat(F.lit("out/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modified"), (F.col("o_orderstatus") != "P").alias("complete")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS generated, strftime(ts, '[%H:%M:%S]') AS stamp FROM events")
def run_stamps(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("generated"), F.date_format("ts", "'['HH:mm:ss']'").alias("stamp"))


# ---- text pixels and colours

_GLYPH = f"""WITH {PIXELS}, X AS (SELECT vec_id, b, g, r, k < 4 AND vec_id % 3 > 0 AS border FROM P),
    B AS (SELECT vec_id, coalesce(median(b) FILTER (border), avg(b)) AS bb, coalesce(median(g) FILTER (border), avg(g)) AS bg, coalesce(median(r) FILTER (border), avg(r)) AS br FROM X GROUP BY 1),
    D AS (SELECT vec_id, least(255, floor(3 * sqrt((b - bb) * (b - bb) + (g - bg) * (g - bg) + (r - br) * (r - br)))::BIGINT) AS d FROM X JOIN B USING (vec_id)),
    T AS (SELECT a.vec_id, a.d AS t, count(*) FILTER (o.d <= a.d) AS n0, sum(o.d) FILTER (o.d <= a.d) AS s0, count(*) AS n, sum(o.d) AS s FROM (SELECT DISTINCT vec_id, d FROM D) a JOIN D o ON o.vec_id = a.vec_id GROUP BY ALL),
    L AS (SELECT vec_id, t AS level FROM T QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN n0 < n THEN (s0 * n - s * n0)::DOUBLE * (s0 * n - s * n0)::DOUBLE / (n0 * (n - n0))::DOUBLE ELSE 0 END DESC, t) = 1),
    G AS (SELECT vec_id, level, count(*) AS n, count(*) FILTER (d >= greatest(12, 0.65::DOUBLE * level)) AS n_glyph FROM D JOIN L USING (vec_id) GROUP BY ALL)"""


@query(f"{_GLYPH} SELECT vec_id, level, n, n_glyph, n_glyph / n < 0.015 OR n_glyph / n > 0.68 AS coarse FROM G")
def glyph_threshold(spark: S, sf: str) -> DataFrame:
    px = pixels(spark, sf).withColumn("border", (F.col("k") < 4) & (F.col("vec_id") % 3 > 0))
    return stats.glyph_threshold(px, "vec_id")


@query(f"WITH {PIXELS}, C AS (SELECT vec_id, vec_id % 4 = 0 OR hole AS hole, b, g, r FROM P) SELECT vec_id // 4 AS region, " + ", ".join(f"CASE WHEN count(*) FILTER (NOT hole) > 50 THEN trunc(median({c}) FILTER (NOT hole))::BIGINT ELSE 80 END AS {c}" for c in "bgr") + " FROM C GROUP BY 1")
def hole_prefill(spark: S, sf: str) -> DataFrame:
    px = pixels(spark, sf).withColumn("hole", (F.col("vec_id") % 4 == 0) | F.col("hole")).withColumn("region", F.floor(F.col("vec_id") / 4))
    return stats.prefill(px, "region")


@query(f"""WITH {TEXTS}, X AS (SELECT image_id, ord, h, length(text) = 1 AND regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]') OR ord % 5 = 0 AS one FROM T)
    SELECT image_id, ord, CASE WHEN one THEN greatest(3, least(8, round_even(h * 0.16::DOUBLE, 0)::BIGINT)) ELSE greatest(2, least(6, round_even(h * 0.09::DOUBLE, 0)::BIGINT)) END AS radius FROM X""")
def dilate_radius(spark: S, sf: str) -> DataFrame:
    """Every fifth detection counts as a single CJK character, since the texts have none."""
    t = texts(spark, sf)
    one = ((F.length("text") == 1) & has_cjk(F.col("text"))) | (F.col("ord") % 5 == 0)
    return t.select("image_id", "ord", gates.dilate_radius(F.col("h").cast("double"), one).alias("radius"))


# ---- exports


@query(f"WITH {SMALL} SELECT image_id, layer_id, concat_ws(',', x0, y0, x1 - x0, y1 - y0) AS rect, concat_ws(',', x0, y0, x1 - 1, y1 - 1) AS mask_bbox, ((x1 - x0) * (y1 - y0))::BIGINT AS alpha_px FROM S")
def mask_rects(spark: S, sf: str) -> DataFrame:
    r = masks.rects(raster.from_boxes(small(layers(spark, sf))))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return r.select("image_id", "layer_id", text("rect"), text("mask_bbox"), "alpha_px")


@query(f"""WITH {SMALL}, M AS (SELECT DISTINCT image_id, y, unnest(range(x0, x1)) AS x FROM R WHERE ord % 9 = 0), G AS (SELECT image_id, unnest(range(greatest(0, y0 - 3), least({SMALL_H}, y1 + 3))) AS y, greatest(0, x0 - 3) AS a, least({SMALL_W}, x1 + 3) AS c FROM S WHERE ord % 9 = 0), GP AS (SELECT DISTINCT image_id, y, unnest(range(a, c)) AS x FROM G)
    SELECT image_id, count(*) AS pixels FROM GP ANTI JOIN M USING (image_id, y, x) GROUP BY 1""")
def background_ring(spark: S, sf: str) -> DataFrame:
    """The softened edge around what is cut out of the background."""
    s = small(layers(spark, sf)).filter("ord % 9 = 0")
    return masks.ring(raster.from_boxes(s), 3, SMALL_W, SMALL_H).groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


@query(f"WITH {LAYERS}, E AS (SELECT kind, greatest(abs(q % 3), abs(q % 5 - 2), 1) AS error FROM L WHERE q % 13 <> 0) SELECT kind, printf('%.1f', avg(error))::DOUBLE AS mean, max(error) AS most, count(*) AS n FROM E GROUP BY 1")
def box_error_summary(spark: S, sf: str) -> DataFrame:
    x, q = layers(spark, sf), F.col("q")
    truth = x.filter("q % 13 <> 0").select("id", (F.col("x0") + q % 3).alias("x0"), (F.col("y0") + q % 5 - 2).alias("y0"), "x1", (F.col("y1") + 1).alias("y1"))
    return audit.error_summary(audit.box_error(x.select("id", "x0", "y0", "x1", "y1"), truth).join(x.select("id", "kind"), "id"), "kind")


@query(f"""WITH {TEXTS}, X AS (SELECT image_id, CASE WHEN score < 0.35 THEN 'low_conf' WHEN regexp_full_match(text, '[A-Za-z]') AND score < 0.85 THEN 'single_latin' WHEN score < 0.85 AND w > 0 AND h >= 2.4 * w THEN 'vertical_deco' END AS reason FROM T),
    N AS (SELECT image_id, reason, count(*) AS n FROM X WHERE reason IS NOT NULL GROUP BY ALL) SELECT image_id, string_agg(reason || '=' || n::VARCHAR, ';' ORDER BY reason) AS reasons FROM N GROUP BY 1""")
def drop_reasons(spark: S, sf: str) -> DataFrame:
    """Why detections of an image went, as a map."""
    m = audit.reason_counts(texts(spark, sf).withColumn("reason", gates.text_reason()), "image_id", "reason")
    pairs = F.transform(F.map_entries("reasons"), lambda e: F.concat(e.getField("key"), F.lit("="), e.getField("value").cast("string")))
    return m.select("image_id", F.array_join(pairs, ";").alias("reasons"))

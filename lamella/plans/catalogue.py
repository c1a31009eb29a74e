"""The registered queries over the driver's tables, each beside its SQL. All run over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions import geometry as geo
from lamella.functions.text import family_of, has_cjk, is_number, is_single_latin, json_in
from lamella.operators import audit, dense, gates, occlusion, pack, plan, raster, scoring, stats
from lamella.plans import views
from lamella.plans.registry import ORACLES, QUERIES, query
from lamella.plans.views import ATTEMPTS, LAYERS, PIXELS, SMALL, TEXTS, H, W, attempts, layers, pixels, small, texts
from lamella.sources.tables import table, with_overrides

S = SparkSession


# ---- text detections

_REASON = """CASE WHEN score < 0.35 THEN 'low_conf' WHEN regexp_full_match(text, '[A-Za-z]') AND score < 0.85 THEN 'single_latin'
    WHEN score < 0.85 AND w > 0 AND h >= 2.4 * w THEN 'vertical_deco' END"""


@query(f"WITH {TEXTS} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM T GROUP BY 1")
def ocr_filter_reasons(spark: S, sf: str) -> DataFrame:
    return texts(spark, sf).groupBy(F.coalesce(gates.text_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {TEXTS}, K AS (SELECT * FROM T WHERE {_REASON} IS NULL) SELECT image_id, ord, printf('text_%03d', row_number() OVER (PARTITION BY image_id ORDER BY ord)) AS id FROM K")
def ocr_stable_ids(spark: S, sf: str) -> DataFrame:
    return gates.stable_ids(texts(spark, sf).filter(gates.text_reason().isNull()), ["ord"]).select("image_id", "ord", "id")


@query(f"WITH {TEXTS} SELECT lang, regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]') AS cjk, regexp_full_match(text, '\\d{{3,}}') AS number, regexp_full_match(text, '[A-Za-z]') AS latin, count(*) AS n FROM T GROUP BY ALL")
def text_script_class(spark: S, sf: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf).groupBy("lang", has_cjk(t).alias("cjk"), is_number(t).alias("number"), is_single_latin(t).alias("latin")).agg(F.count("*").alias("n"))


@query(f"""WITH {TEXTS}, X AS (SELECT image_id, ord, h, regexp_full_match(lang, 'en|fr') AS wide, score AS coverage, w * 6 AS fg, h * 2 AS bg FROM T)
    SELECT image_id, ord, greatest(8, round_even(h * CASE WHEN wide THEN 0.88::DOUBLE ELSE 0.82::DOUBLE END, 0)::BIGINT) AS size, CASE WHEN coverage >= 0.17 THEN 700 ELSE 600 END AS weight,
        0.2126 * fg + 0.7152 * fg + 0.0722 * fg >= 0.2126 * bg + 0.7152 * bg + 0.0722 * bg AS dark_stroke,
        greatest(0, least(2, round_even(h * CASE WHEN coverage > 0.12 THEN 0.045::DOUBLE ELSE 0.03::DOUBLE END, 0)::BIGINT)) AS stroke,
        printf('#%02x%02x%02x', fg::INT, fg::INT, bg::INT) AS colour FROM X""")
def text_style(spark: S, sf: str) -> DataFrame:
    fg, bg = F.col("w") * 6, F.col("h") * 2
    style = gates.text_style(F.col("h").cast("double"), F.col("lang").isin("en", "fr"), F.col("score"), geo.luma(fg, fg, fg), geo.luma(bg, bg, bg))
    return texts(spark, sf).select("image_id", "ord", style.alias("s"), geo.hex_colour(fg, fg, bg).alias("colour")).select("image_id", "ord", "s.*", "colour")


# ---- plans


@query("SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events")
def plan_json_extract(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = F.col("event_id") % 3
    content = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("The plan is "), "props", F.lit(" as asked.")))
    return e.select("event_id", F.get_json_object(json_in(content), "$.k").cast("long").alias("k"))


_RAW = """N AS (SELECT image_id, ord, CASE WHEN q % 3 = 0 THEN '' WHEN q % 7 = 0 THEN NULL ELSE kind END AS kind, CASE WHEN q % 4 = 0 THEN '' ELSE 'container' END AS role,
    CASE WHEN q % 5 = 0 THEN 'other' ELSE mode END AS mode, CASE WHEN q % 6 = 0 THEN 'top' ELSE z::VARCHAR END AS z FROM L)"""


def _raw(layer: DataFrame) -> DataFrame:
    q = F.col("q")
    return layer.select(
        "image_id", "ord", F.when(q % 3 == 0, "").when(q % 7 == 0, F.lit(None)).otherwise(F.col("kind")).alias("kind"), F.when(q % 4 == 0, "").otherwise("container").alias("role"),
        F.when(q % 5 == 0, "other").otherwise(F.col("mode")).alias("mode"), F.when(q % 6 == 0, "top").otherwise(F.col("z").cast("string")).alias("z"),
    )


@query(f"""WITH {LAYERS}, {_RAW} SELECT image_id, ord, coalesce(nullif(kind, ''), 'icon') AS kind, coalesce(nullif(role, ''), 'foreground') AS role,
    CASE WHEN mode IN ('image', 'surface', 'none') THEN mode ELSE 'none' END AS mode, coalesce(TRY_CAST(z AS INT), 0) AS z FROM N""")
def query_normalise(spark: S, sf: str) -> DataFrame:
    return plan.normalise(_raw(layers(spark, sf)))


@query(f"""WITH {LAYERS}, B AS (SELECT image_id, ord, CASE WHEN q % 11 = 0 THEN NULL ELSE x0 / 1000.0::DOUBLE END AS nx0, y0 / 2000.0::DOUBLE AS ny0, (x1 - q % 60 * 5) / 1000.0::DOUBLE AS nx1, y1 / 2000.0::DOUBLE AS ny1 FROM L),
    C AS (SELECT *, nx0 IS NULL AS m, trunc(nx0 * {W})::INT AS a0, trunc(nx1 * {W})::INT AS a1, trunc(ny0 * {H})::INT AS b0, trunc(ny1 * {H})::INT AS b1 FROM B)
    SELECT image_id, ord, CASE WHEN m THEN 0 ELSE greatest(0, least(a0, a1, {W - 1})) END AS x0, CASE WHEN m THEN 0 ELSE greatest(0, least(b0, b1, {H - 1})) END AS y0,
        CASE WHEN m THEN {W - 1} ELSE greatest(1, least(greatest(a0, a1), {W - 1})) END AS x1, CASE WHEN m THEN {H - 1} ELSE greatest(1, least(greatest(b0, b1), {H - 1})) END AS y1 FROM C""")
def coords_to_px(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    b = x.select("image_id", "ord", F.when(F.col("q") % 11 == 0, F.lit(None)).otherwise(F.col("x0") / 1000.0).alias("nx0"), (F.col("y0") / 2000.0).alias("ny0"), ((F.col("x1") - F.col("q") % 60 * 5) / 1000.0).alias("nx1"), (F.col("y1") / 2000.0).alias("ny1"))
    return plan.to_pixels(b, F.lit(W), F.lit(H)).select("image_id", "ord", "x0", "y0", "x1", "y1")


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, ord, id AS query_id, q % 4 AS n, unnest(range(q % 4)) AS k FROM L)
    SELECT image_id, ord, query_id, CASE WHEN n > 1 THEN query_id || '_h' || (k + 1)::VARCHAR ELSE query_id END AS id, k AS instance_index, n AS instance_count FROM X""")
def instance_explode(spark: S, sf: str) -> DataFrame:
    hints = F.slice(F.array(*[F.lit(k) for k in range(4)]), F.lit(1), F.col("q") % 4)
    return plan.expand(layers(spark, sf).select("image_id", "ord", "id", hints.alias("hints"))).select("image_id", "ord", "query_id", "id", "instance_index", "instance_count")


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, ord, base_id, row_number() OVER (PARTITION BY image_id, base_id ORDER BY ord) - 1 AS n FROM L)
    SELECT image_id, ord, CASE WHEN n > 0 THEN base_id || '__' || n::VARCHAR ELSE base_id END AS id FROM X""")
def duplicate_id_suffix(spark: S, sf: str) -> DataFrame:
    return plan.unique_ids(layers(spark, sf).select("image_id", "ord", F.col("base_id").alias("id")), ["ord"])


_NAMED = "'btn' || (l_partkey % 50)::VARCHAR || CASE l_linenumber % 4 WHEN 0 THEN '_r1c' || q::VARCHAR WHEN 1 THEN '_h2' WHEN 2 THEN '_3' ELSE '' END"


def _named() -> F.Column:
    n = F.col("l_linenumber") % 4
    end = F.when(n == 0, F.concat(F.lit("_r1c"), F.col("q").cast("string"))).when(n == 1, "_h2").when(n == 2, "_3").otherwise("")
    return F.concat(F.lit("btn"), (F.col("l_partkey") % 50).cast("string"), end)


@query(f"WITH {LAYERS} SELECT coalesce(nullif(regexp_replace({_NAMED}, '_(r\\d+c\\d+|h\\d+|i\\d+|\\d+)$', ''), ''), {_NAMED}) AS family, count(*) AS n, count(DISTINCT {_NAMED}) AS n_ids FROM L GROUP BY 1")
def family_rollup(spark: S, sf: str) -> DataFrame:
    return layers(spark, sf).select(_named().alias("id")).groupBy(family_of(F.col("id")).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query(f"""WITH {LAYERS}, C AS (SELECT image_id, ord, x0, y0, x1 - q * 5 AS x1, y1, CASE WHEN q % 4 = 0 THEN 0.0 ELSE q / 50.0::DOUBLE END AS confidence FROM L)
    SELECT image_id, ord, x0, y0, x1, y1, coalesce(nullif(confidence, 0.0), 0.5)::DOUBLE AS confidence FROM C WHERE x1 - x0 >= 2 AND y1 - y0 >= 2""")
def text_corrections(spark: S, sf: str) -> DataFrame:
    c = layers(spark, sf).select("image_id", "ord", "x0", "y0", (F.col("x1") - F.col("q") * 5).alias("x1"), "y1", F.when(F.col("q") % 4 == 0, F.lit(0.0)).otherwise(F.col("q") / 50.0).alias("confidence"))
    return plan.corrections(c)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 97 <> 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def unknown_ids_anti(spark: S, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.filter("o_custkey % 97 <> 0").join(c.filter("c_acctbal > 0"), o.o_custkey == c.c_custkey, "left_anti").select("o_orderkey")


@query("SELECT r_name AS parent, string_agg(n_name, ',' ORDER BY n_nationkey) AS children, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def children_map(spark: S, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    return plan.children(rows, "r_name", "n_name", "n_nationkey").select(F.col("r_name").alias("parent"), F.array_join("children", ",").alias("children"), F.size("children").cast("long").alias("n"))


@query("""WITH RECURSIVE E AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
    up AS (SELECT node, 0 AS depth, node AS root FROM E WHERE parent IS NULL UNION ALL SELECT E.node, depth + 1, root FROM E JOIN up ON E.parent = up.node)
    SELECT node, depth, root FROM up""")
def parent_chain_depth(spark: S, sf: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = table(spark, sf, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"))
    c = table(spark, sf, "customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"))
    return plan.depths(r.unionByName(n).unionByName(c))


@query("""WITH X AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS k FROM customer)
    SELECT c_nationkey, c_custkey FROM X WHERE k = 1""")
def plan_source_precedence(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("rank", F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)).withColumn("less", -F.col("c_acctbal"))
    return plan.preferred(c, "c_nationkey", ["rank", "less", "c_custkey"]).select("c_nationkey", "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE 'default' END AS style, 5 AS margin FROM part")
def case_overrides(spark: S, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    defaults = p.select("p_partkey", F.lit("default").alias("style"), F.lit(5).alias("margin"))
    return with_overrides(defaults, p.filter("p_size > 25").select("p_partkey", F.col("p_brand").alias("style"), F.lit(9).alias("margin")), "p_partkey", ["style"])


# ---- occlusion

_SIDES = "greatest(0, least(a.x1, b.x1 + {r}) - greatest(a.x0, b.x0 - {r})) * greatest(0, least(a.y1, b.y1 + {r}) - greatest(a.y0, b.y0 - {r}))"
_OVER = f"""EDGE AS (SELECT a.image_id, a.id AS under_id, b.id AS over_id, {_SIDES.format(r=0)} AS pixels
    FROM L a JOIN L b ON a.image_id = b.image_id AND b.z > a.z AND a.x0 < b.x1 + 2 AND b.x0 - 2 < a.x1 AND a.y0 < b.y1 + 2 AND b.y0 - 2 < a.y1
    WHERE {_SIDES.format(r=0)} > 100 OR {_SIDES.format(r=2)} > 20)"""


@query(f"WITH {LAYERS}, {_OVER} SELECT image_id, under_id, over_id, pixels FROM EDGE")
def occlusion_edges(spark: S, sf: str) -> DataFrame:
    return occlusion.edges(layers(spark, sf), touch=True)


@query(f"""WITH {LAYERS}, {_OVER}, N AS (SELECT image_id, under_id AS id, count(*) AS n_over FROM EDGE GROUP BY ALL)
    SELECT L.image_id, mode, count(*) AS n_layers, sum(coalesce(n_over, 0))::BIGINT AS n_edges, count(*) FILTER (n_over > 0 AND mode <> 'none') AS n_repair FROM L LEFT JOIN N USING (image_id, id) GROUP BY ALL""")
def occlusion_summary(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    return occlusion.needs_repair(x, occlusion.edges(x, touch=True)).groupBy("image_id", "mode").agg(F.count("*").alias("n_layers"), F.sum("n_over").alias("n_edges"), F.count_if("needs_repair").alias("n_repair"))


@query(f"""WITH {LAYERS}, {_OVER}, KIN AS (SELECT a.image_id, a.id AS under_id, b.id AS over_id FROM L a JOIN L b ON a.image_id = b.image_id AND b.ord = a.ord + 1 AND a.q % 3 = 0)
    SELECT image_id, coalesce(k.under_id, e.under_id) AS under_id, coalesce(k.over_id, e.over_id) AS over_id, CASE WHEN k.under_id IS NULL THEN 'geometry' ELSE 'parent' END AS via
    FROM KIN k FULL JOIN EDGE e USING (image_id, under_id, over_id)""")
def occlusion_with_parents(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    a, b = x.filter("q % 3 = 0").alias("a"), x.alias("b")
    kin = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("b.ord") == F.col("a.ord") + 1)).select("a.image_id", F.col("a.id").alias("parent_id"), F.col("b.id").alias("child_id"))
    return occlusion.with_children(occlusion.edges(x, touch=True), kin)


@query(f"""WITH {LAYERS}, M AS (SELECT image_id, ord, id, x0 // 30 * 30 AS x0, y0 // 60 * 60 AS y0, x0 // 30 * 30 + q // 10 * 10 + 30 AS x1, y0 // 60 * 60 + q // 10 * 10 + 30 AS y1, kind || (q % 5)::VARCHAR AS family FROM L),
    G AS (SELECT *, count(*) OVER (PARTITION BY image_id, family) AS nf, (x1 - x0) * (y1 - y0) AS area FROM M),
    J AS (SELECT a.image_id, a.id AS ai, b.id AS bi, a.ord AS ao, b.ord AS bo, a.nf < b.nf OR (a.nf = b.nf AND a.area < b.area) AS first, a.area + b.area AS total, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s
        FROM G a JOIN G b ON a.image_id = b.image_id AND a.ord < b.ord AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
    P AS (SELECT image_id, CASE WHEN first THEN ai ELSE bi END AS loser, CASE WHEN first THEN bi ELSE ai END AS keeper, ao, bo FROM J WHERE s >= 200 AND s > 0.6::DOUBLE * (total - s)),
    K AS (SELECT *, row_number() OVER (PARTITION BY image_id, loser ORDER BY ao DESC, bo DESC) AS k FROM P)
    SELECT image_id, loser, keeper FROM K WHERE k = 1""")
def duplicate_boxes_iou(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    grid = lambda c, n: F.floor(F.col(c) / n) * n
    side = F.floor(F.col("q") / 10) * 10 + 30
    m = x.select("image_id", "ord", "id", grid("x0", 30).alias("x0"), grid("y0", 60).alias("y0"), (grid("x0", 30) + side).alias("x1"), (grid("y0", 60) + side).alias("y1"), F.concat("kind", (F.col("q") % 5).cast("string")).alias("family"))
    return occlusion.duplicates(m)


@query(f"WITH {LAYERS}, {_OVER} SELECT e.image_id, under_id, over_id FROM EDGE e JOIN L ON L.image_id = e.image_id AND L.id = over_id WHERE pixels >= 0.5 * (x1 - x0) * (y1 - y0)")
def containment_pairs(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    return occlusion.contained(occlusion.edges(x, touch=True), x)


@query(f"""WITH {LAYERS}, J AS (SELECT a.image_id, a.id, b.id AS hit, b.ord, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) AS area
        FROM L a JOIN L b ON a.image_id = b.image_id AND b.kind = 'icon' AND a.kind = 'badge' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
    F AS (SELECT image_id, id, arg_min(hit, ord) AS hit FROM J WHERE s > 0.5 * area GROUP BY ALL)
    SELECT L.image_id, L.id, hit, CASE WHEN q % 9 = 0 AND hit IS NOT NULL THEN 'id' WHEN q % 9 = 0 AND q % 2 = 0 THEN 'id' WHEN hit IS NOT NULL THEN 'bbox' END AS why FROM L LEFT JOIN F USING (image_id, id) WHERE kind = 'badge'""")
def raster_first_hit(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    found = occlusion.first_hit(x.filter("kind = 'badge'"), x.filter("kind = 'icon'"))
    return found.select("image_id", "id", "hit", gates.render(F.col("q") % 9 == 0, F.col("hit"), F.col("q") % 2 == 0).getField("why").alias("why"))


@query(f"""WITH {LAYERS}, P AS (SELECT image_id, floor(l_extendedprice)::BIGINT % 900 AS x, ord * 17 % 1900 AS y FROM L), D AS (SELECT DISTINCT * FROM P),
    J AS (SELECT D.image_id, D.x, D.y, L.id, L.ord, sqrt((D.x - (x0 + x1) / 2) * (D.x - (x0 + x1) / 2) + (D.y - (y0 + y1) / 2) * (D.y - (y0 + y1) / 2))::FLOAT AS d FROM D JOIN L ON D.image_id = L.image_id AND D.x >= x0 AND D.x < x1 AND D.y >= y0 AND D.y < y1),
    K AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY d, ord DESC) AS k FROM J) SELECT image_id, x, y, id AS owner FROM K WHERE k = 1""")
def nearest_owner(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    points = x.select("image_id", (F.floor("l_extendedprice") % 900).alias("x"), (F.col("ord") * 17 % 1900).alias("y")).distinct()
    return occlusion.nearest(points, x)


# ---- candidates

_CANDIDATES = """C AS (SELECT image_id, ord AS layer_id, k, (q * (k + 3) % 17) / 16.0::DOUBLE + 0.22 * ((l_linenumber + k) % 3 / 2.0::DOUBLE) - 0.38 * (q % (k + 2) / 4.0::DOUBLE) + 0.10 * (l_partkey % 5 / 4.0::DOUBLE) + 0.06 * (l_suppkey % 3 / 2.0::DOUBLE) AS score
    FROM L, (SELECT unnest(range(3)) AS k) WHERE NOT (q % 10 = 0 AND k > 0))"""


def _candidates(x: DataFrame) -> DataFrame:
    c = x.withColumn("k", F.explode(F.when(F.col("q") % 10 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))))
    q, k = F.col("q"), F.col("k")
    s = scoring.score((q * (k + 3) % 17) / 16.0, (F.col("l_linenumber") + k) % 3 / 2.0, q % (k + 2) / 4.0, F.col("l_partkey") % 5 / 4.0, F.col("l_suppkey") % 3 / 2.0)
    return c.select("image_id", F.col("ord").alias("layer_id"), "k", s.alias("score"))


_BEST = f"{_CANDIDATES}, O AS (SELECT *, row_number() OVER (PARTITION BY image_id, layer_id ORDER BY score DESC, k) AS r, printf('%.4f', score - lead(score) OVER (PARTITION BY image_id, layer_id ORDER BY score DESC, k))::DOUBLE AS margin FROM C)"


@query(f"WITH {LAYERS}, {_BEST} SELECT image_id, layer_id, k FROM O WHERE r = 1")
def candidate_score_best(spark: S, sf: str) -> DataFrame:
    return scoring.best(_candidates(layers(spark, sf))).select("image_id", "layer_id", "k")


@query(f"""WITH {LAYERS}, {_BEST}, M AS (SELECT image_id, round(margin * 10000)::BIGINT AS m FROM O WHERE r = 1 AND margin IS NOT NULL), X AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM M)
    SELECT image_id, min(m) AS least, max(CASE WHEN i = n // 2 THEN m END) AS upper_median, max(m) AS most FROM X GROUP BY 1""")
def candidate_margin(spark: S, sf: str) -> DataFrame:
    m = scoring.best(_candidates(layers(spark, sf))).filter("margin is not null").withColumn("m", F.round(F.col("margin") * 10000).cast("long"))
    return m.groupBy("image_id").agg(F.min("m").alias("least"), scoring.upper_median("m").alias("upper_median"), F.max("m").alias("most"))


@query(f"""WITH {LAYERS}, {_BEST}, A AS (SELECT image_id, layer_id, row_number() OVER (PARTITION BY image_id ORDER BY layer_id) AS k FROM O WHERE r = 1 AND margin < 0.15) SELECT image_id, layer_id FROM A WHERE k <= 12""")
def ambiguous_layers(spark: S, sf: str) -> DataFrame:
    b = scoring.best(_candidates(layers(spark, sf))).withColumn("ord", F.col("layer_id"))
    return scoring.ambiguous(b).select("image_id", "layer_id")


# ---- groups, versions, logs


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, kind, round_even((x1 - x0) / 16, 0)::BIGINT AS gx, round_even((y1 - y0) / 16, 0)::BIGINT AS gy, count(*) AS n FROM L WHERE mode = 'none' GROUP BY ALL) SELECT * FROM X WHERE n >= 3""")
def sprite_groups(spark: S, sf: str) -> DataFrame:
    return audit.sprite_groups(layers(spark, sf))


@query(f"""WITH {LAYERS}, X AS (SELECT kind || (l_partkey % 200)::VARCHAR AS family, x1 - x0 AS w, y1 - y0 AS h, (l_discount * 100)::INT AS alpha, mode FROM L)
    SELECT family, count(*) AS n, count(DISTINCT (w, h)) AS n_sizes, min(alpha) AS alpha_min, max(alpha) AS alpha_max, bool_and(mode = 'none') AS all_none FROM X GROUP BY 1 HAVING count(*) >= 3""")
def family_consistency(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).select(F.concat("kind", (F.col("l_partkey") % 200).cast("string")).alias("family"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), F.round(F.col("l_discount") * 100).cast("int").alias("alpha"), "mode")
    return audit.family_consistency(x)


@query(f"""WITH {LAYERS}, X AS (SELECT id, (x1 - x0) * (y1 - y0) AS new, (x1 - x0 - q % 7) * (y1 - y0) AS old FROM L WHERE q % 13 <> 0)
    SELECT id, new - old AS gain, printf('%.1f', 100 * (new - old) / greatest(1, old)::DOUBLE)::DOUBLE AS pct FROM X""")
def version_compare(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    old = x.filter("q % 13 <> 0").select("id", ((F.col("x1") - F.col("x0") - F.col("q") % 7) * (F.col("y1") - F.col("y0"))).alias("area"))
    return audit.version_gain(x.select("id", geo.area().alias("area")), old)


@query(f"WITH {LAYERS} SELECT id, greatest(abs(q % 3), abs(q % 5 - 2), 1) AS error FROM L WHERE q % 13 <> 0")
def bbox_error(spark: S, sf: str) -> DataFrame:
    x, q = layers(spark, sf), F.col("q")
    truth = x.filter("q % 13 <> 0").select("id", (F.col("x0") + q % 3).alias("x0"), (F.col("y0") + q % 5 - 2).alias("y0"), "x1", (F.col("y1") + 1).alias("y1"))
    return audit.box_error(x.select("id", "x0", "y0", "x1", "y1"), truth)


@query(f"""WITH {ATTEMPTS}, K AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM A) SELECT c_custkey AS key, c_name, kind, event_id FROM customer LEFT JOIN (SELECT * FROM K WHERE k = 1) ON key = c_custkey""")
def repair_first_log(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return gates.first_log(c, attempts(spark, sf), "key", ["ts", "event_id"]).select("key", "c_name", "kind", "event_id")


@query(f"""WITH {ATTEMPTS}, X AS (SELECT *, row_number() OVER w AS k, coalesce(max((error IS NOT NULL)::INT) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM A WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
    G AS (SELECT key, min(CASE WHEN accepted AND error IS NULL THEN k END) AS accepted_at, count(*) AS valid_attempts FROM X WHERE failed = 0 GROUP BY 1) SELECT *, coalesce(accepted_at, valid_attempts) AS used FROM G""")
def attempt_first_accepted(spark: S, sf: str) -> DataFrame:
    return gates.first_accepted(attempts(spark, sf), "key", ["ts", "event_id"])


@query(f"WITH {ATTEMPTS} SELECT kind, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(error) AS n_errors, (sum(seconds * 100)::BIGINT) // 100 AS seconds FROM A GROUP BY 1")
def call_stats_by_kind(spark: S, sf: str) -> DataFrame:
    return attempts(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.count("error").alias("n_errors"), F.floor(F.round(F.sum(F.col("seconds") * 100)) / 100).alias("seconds"))


@query(f"WITH {ATTEMPTS} SELECT key, arg_max(event_id, ts) AS event_id FROM A GROUP BY 1")
def newest_run(spark: S, sf: str) -> DataFrame:
    return gates.latest(attempts(spark, sf), "key", "ts", "event_id")


@query(f"""WITH {LAYERS}, X AS (SELECT id, (x1 - x0) * (1 + q % 23) AS w, (y1 - y0) * (1 + q % 17) AS h FROM L), F AS (SELECT *, w * h >= 3686400 AS fits, sqrt(3686400 / (w * h)::DOUBLE) AS s FROM X),
    A AS (SELECT id, CASE WHEN fits THEN w ELSE ceil(w * s)::BIGINT END AS aw, CASE WHEN fits THEN h ELSE ceil(h * s)::BIGINT END AS h0 FROM F),
    B AS (SELECT id, aw, list_filter(range(h0, h0 + 200), lambda k: aw * k >= 3686400)[1] AS ah FROM A)
    SELECT id, CASE WHEN greatest(aw, ah) <= 2800 THEN aw END AS w, CASE WHEN greatest(aw, ah) <= 2800 THEN ah END AS h FROM B""")
def provider_ask_size(spark: S, sf: str) -> DataFrame:
    size = gates.ask_size((F.col("x1") - F.col("x0")) * (1 + F.col("q") % 23), (F.col("y1") - F.col("y0")) * (1 + F.col("q") % 17))
    return layers(spark, sf).select("id", size.alias("s")).select("id", F.col("s.w").alias("w"), F.col("s.h").alias("h"))


_TOKEN = "least(999, greatest(0, round_even({v} / {n}.0::DOUBLE * 1000, 0)::BIGINT))"


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, id, q % 9 = 0 AS none, greatest(0, x0 - 8) AS a, greatest(0, y0 - 8) AS b, least({W}, x1 + 8) AS c, least({H}, y1 + 8) AS d FROM L)
    SELECT image_id, id, CASE WHEN NOT none THEN concat_ws(' ', {_TOKEN.format(v="a", n=W)}, {_TOKEN.format(v="b", n=H)}, {_TOKEN.format(v="c", n=W)}, {_TOKEN.format(v="d", n=H)}) END AS token FROM X""")
def hole_box_token(spark: S, sf: str) -> DataFrame:
    """A hole's box as tokens; no token for an empty hole."""
    x = layers(spark, sf)
    box = [F.when(F.col("q") % 9 != 0, F.col(c)) for c in ("x0", "y0", "x1", "y1")]
    return x.select("image_id", "id", gates.box_tokens(*box, W, H, pad=8).alias("token"))


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, ord, CASE WHEN q % 5 <> 0 THEN concat_ws(' ', {_TOKEN.format(v="x0", n=W)}, {_TOKEN.format(v="y0", n=H)}, {_TOKEN.format(v="x1", n=W)}, {_TOKEN.format(v="y1", n=H)}) END AS t, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM L)
    SELECT image_id, string_agg('<bbox>' || t || '</bbox>', ' ' ORDER BY ord) AS regions FROM X WHERE k <= 12 GROUP BY 1""")
def region_tokens(spark: S, sf: str) -> DataFrame:
    """The first twelve regions of an image as tokens; those without a box count among the twelve but give none."""
    box = [F.when(F.col("q") % 5 != 0, F.col(c)) for c in ("x0", "y0", "x1", "y1")]
    rows = layers(spark, sf).select("image_id", "ord", gates.box_tokens(*box, W, H).alias("token"))
    return gates.region_prompt(rows)


@query(f"WITH {LAYERS} SELECT id, substr(md5(concat_ws('|', id, mode, x0::VARCHAR, y0::VARCHAR)), 1, 16) AS cache_key FROM L")
def cache_key_md5(spark: S, sf: str) -> DataFrame:
    return layers(spark, sf).select("id", gates.cache_key(F.col("id"), F.col("mode"), F.col("x0").cast("string"), F.col("y0").cast("string")).alias("cache_key"))


@query(f"""WITH {LAYERS}, X AS (SELECT mode, q * 3 - 40 AS hole FROM L) SELECT CASE WHEN mode = 'surface' AND hole > 0 THEN 'surface' WHEN mode = 'image' AND hole >= 30 THEN 'image-gen' WHEN mode = 'image' AND hole > 0 THEN 'too-small' ELSE 'none' END AS route, count(*) AS n, sum(hole)::BIGINT AS pixels FROM X GROUP BY 1""")
def repair_routing(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).select("mode", (F.col("q") * 3 - 40).alias("hole"))
    return x.groupBy(gates.repair_route(F.col("mode"), F.col("hole")).alias("route")).agg(F.count("*").alias("n"), F.sum("hole").alias("pixels"))


# ---- colours


@query(f"""WITH {PIXELS}, K AS (SELECT label, least(b // 32 * 32, 224) AS kb, least(g // 32 * 32, 224) AS kg, least(r // 32 * 32, 224) AS kr, count(*) AS n FROM P GROUP BY ALL),
    C AS (SELECT *, n * (24.0::DOUBLE + sqrt((pow(least(kb + 16, 240) - 10, 2) + pow(least(kg + 16, 240) - 20, 2) + pow(least(kr + 16, 240) - 30, 2))::DOUBLE)) AS worth FROM K),
    O AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY worth DESC, kb, kg, kr) AS i FROM C) SELECT label, least(kb + 16, 240) AS b, least(kg + 16, 240) AS g, least(kr + 16, 240) AS r, n FROM O WHERE i = 1""")
def bucket_dominant(spark: S, sf: str) -> DataFrame:
    return stats.dominant_bucket(pixels(spark, sf), "label", (10, 20, 30))


@query(f"WITH {PIXELS} SELECT label, hole, median(b)::DOUBLE AS b, median(g)::DOUBLE AS g, median(r)::DOUBLE AS r FROM P GROUP BY ALL")
def channel_median(spark: S, sf: str) -> DataFrame:
    return stats.medians(pixels(spark, sf), "label", "hole")


@query(f"""WITH {PIXELS}, X AS (SELECT label, count(*) FILTER (hole) AS n, count(*) FILTER (hole AND greatest(b, g, r) < 8) AS dark, sum(b + g + r) FILTER (hole) AS s, sum(b * b + g * g + r * r) FILTER (hole) AS ss,
        median(b) FILTER (hole) - median(b) FILTER (NOT hole AND greatest(b, g, r) > 8) AS db, median(g) FILTER (hole) - median(g) FILTER (NOT hole AND greatest(b, g, r) > 8) AS dg, median(r) FILTER (hole) - median(r) FILTER (NOT hole AND greatest(b, g, r) > 8) AS dr FROM P GROUP BY 1),
    Y AS (SELECT label, n, dark / n AS black, sqrt(greatest(0, ss / (3 * n) - (s / (3 * n)) * (s / (3 * n)))) AS std, sqrt(db * db + dg * dg + dr * dr) AS delta FROM X)
    SELECT label, n, (black * 10000)::BIGINT AS black, (std * 1000)::BIGINT AS std, (delta * 1000)::BIGINT AS delta, black <= 0.02 OR (std >= 6 AND delta <= 90) AS ok, black <= 0.02 AS ok_strict FROM Y""")
def hole_gate(spark: S, sf: str) -> DataFrame:
    whole = lambda c, n: F.round(F.col(c) * n).cast("long").alias(c)
    return stats.hole_statistics(pixels(spark, sf), "label").select("label", "n", whole("black", 10000), whole("std", 1000), whole("delta", 1000), gates_ok().alias("ok"), gates_ok(True).alias("ok_strict"))


def gates_ok(strict: bool = False):
    return stats.accepted(strict=strict)


@query("""WITH X AS (SELECT lang AS g, n_chars * 7 % 256 AS v FROM documents), Hh AS (SELECT g, v, count(*) AS n FROM X GROUP BY ALL),
    C AS (SELECT g, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY g) AS n, sum(n * v) OVER (PARTITION BY g) AS s FROM Hh WINDOW w AS (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING)),
    B AS (SELECT g, v, CASE WHEN n0 < n THEN (s0 * n - s * n0)::DOUBLE * (s0 * n - s * n0)::DOUBLE / (n0 * (n - n0))::DOUBLE ELSE 0 END AS between_ FROM C),
    O AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY between_ DESC, v) AS k FROM B) SELECT g AS lang, v AS level FROM O WHERE k = 1""")
def otsu_threshold(spark: S, sf: str) -> DataFrame:
    return stats.otsu(table(spark, sf, "documents").select("lang", (F.col("n_chars") * 7 % 256).alias("v")), "lang", "v")


_GRID = f"""{SMALL}, V AS (SELECT image_id, y0 AS y, x0 AS x, max(q_) AS value FROM (SELECT image_id, l_suppkey % 30 AS y0, l_partkey % 30 AS x0, q AS q_ FROM L) GROUP BY ALL)"""


@query(f"""WITH {_GRID}, D AS (SELECT *, coalesce(lead(value) OVER r, value) - coalesce(lag(value) OVER r, value) AS dx, coalesce(lag(value) OVER r, value) + 2 * value + coalesce(lead(value) OVER r, value) AS sx FROM V WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
    E AS (SELECT image_id, y, x, coalesce(lag(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, dx) AS gx, coalesce(lead(sx) OVER c, sx) - coalesce(lag(sx) OVER c, sx) AS gy FROM D WINDOW c AS (PARTITION BY image_id, x ORDER BY y))
    SELECT image_id, y, x, (sqrt((gx * gx + gy * gy)::DOUBLE) * 1000)::BIGINT AS magnitude FROM E""")
def sobel_magnitude(spark: S, sf: str) -> DataFrame:
    v = layers(spark, sf).groupBy("image_id", (F.col("l_suppkey") % 30).alias("y"), (F.col("l_partkey") % 30).alias("x")).agg(F.max("q").alias("value"))
    return stats.sobel(v).withColumn("magnitude", F.round(F.col("magnitude") * 1000).cast("long"))


@query(f"WITH {PIXELS}, X AS (SELECT *, k < 3 AND label % 2 = 0 AS border FROM P) SELECT label, (coalesce(median(b) FILTER (border), avg(b)) * 1000)::BIGINT AS b, (coalesce(median(g) FILTER (border), avg(g)) * 1000)::BIGINT AS g, (coalesce(median(r) FILTER (border), avg(r)) * 1000)::BIGINT AS r FROM X GROUP BY 1")
def base_colour(spark: S, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("border", (F.col("k") < 3) & (F.col("label") % 2 == 0))
    return stats.base_colour(p, "label").select("label", *[F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("b", "g", "r")])


# ---- masks

_UNION = """U AS (SELECT image_id, y, x0, x1, CASE WHEN x0 <= max(x1) OVER (PARTITION BY image_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM R),
    U2 AS (SELECT *, sum(opens) OVER (PARTITION BY image_id, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM U), UN AS (SELECT image_id, y, min(x0) AS x0, max(x1) AS x1 FROM U2 GROUP BY image_id, y, k)"""


@query(f"WITH {SMALL}, PX AS (SELECT DISTINCT image_id, mode, y, unnest(range(x0, x1)) AS x FROM R), I AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, mode, y ORDER BY x) AS k FROM PX) SELECT image_id, mode, y, min(x) AS x0, max(x) + 1 AS x1 FROM I GROUP BY image_id, mode, y, k")
def run_build(spark: S, sf: str) -> DataFrame:
    modes = ["surface", "image", "none"]
    s = small(layers(spark, sf)).withColumn("layer_id", F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode")))
    return raster.merged(raster.bands(s)).select("image_id", F.element_at(F.array(*[F.lit(m) for m in modes]), F.col("layer_id").cast("int")).alias("mode"), "y", "x0", "x1")


@query(f"WITH {SMALL} SELECT a.image_id, a.layer_id AS a_id, b.layer_id AS b_id, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0))::BIGINT AS pixels FROM R a JOIN R b ON a.image_id = b.image_id AND a.y = b.y AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.mode = 'image' AND b.mode = 'surface' GROUP BY ALL")
def run_intersect(spark: S, sf: str) -> DataFrame:
    s = small(layers(spark, sf))
    return raster.intersect(raster.from_boxes(s.filter("mode = 'image'")), raster.from_boxes(s.filter("mode = 'surface'")))


@query(f"WITH {SMALL} SELECT image_id, layer_id, unnest(range(y0 - 2, y1 + 1)) AS y, x0 - 2 AS x0, x1 + 1 AS x1 FROM S")
def run_dilate(spark: S, sf: str) -> DataFrame:
    """A kernel of 4 x 4: it reaches one pixel less to one side."""
    return raster.dilate(raster.from_boxes(small(layers(spark, sf))), 2, 1, 2, 1)


@query(f"WITH {SMALL}, {_UNION} SELECT image_id, sum(x1 - x0)::BIGINT AS pixels, count(*) AS n_runs FROM UN GROUP BY 1")
def run_union_area(spark: S, sf: str) -> DataFrame:
    return raster.union(raster.from_boxes(small(layers(spark, sf)))).groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.count("*").alias("n_runs"))


@query(f"WITH {SMALL}, {_UNION} SELECT image_id, (sum(x1 - x0) * 1000000 // {views.SMALL_W * views.SMALL_H})::BIGINT AS ppm FROM UN GROUP BY 1")
def coverage_ratio(spark: S, sf: str) -> DataFrame:
    u = raster.union(raster.from_boxes(small(layers(spark, sf))))
    return u.groupBy("image_id").agg(F.floor(F.sum(F.col("x1") - F.col("x0")) * 1000000 / (views.SMALL_W * views.SMALL_H)).alias("ppm"))


@query(f"WITH {SMALL}, {_UNION}, B AS (SELECT image_id, coalesce(sum(x1 - x0) FILTER (y < 20), 0)::BIGINT AS pixels FROM UN GROUP BY 1) SELECT image_id, 'status_bar_safe_area' AS id, {views.SMALL_W * 20} - pixels AS pixels FROM B WHERE {views.SMALL_W * 20} - pixels > 100")
def safe_area_row(spark: S, sf: str) -> DataFrame:
    u = raster.union(raster.from_boxes(small(layers(spark, sf)))).filter("y < 20").groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))
    return audit.safe_area(small(layers(spark, sf)), u, views.SMALL_W, 20, 100)


@query(f"""WITH {SMALL}, PX AS (SELECT image_id, y, unnest(range(x0, x1)) AS x, layer_id, z, ord FROM R), O AS (SELECT image_id, y, x, arg_max(layer_id, (z, ord)) AS layer_id FROM PX GROUP BY ALL),
    I AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, layer_id ORDER BY x) AS k FROM O) SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1, layer_id FROM I GROUP BY image_id, y, layer_id, k""")
def paint_topmost(spark: S, sf: str) -> DataFrame:
    """Every pixel of every image, as runs of the layer that paints them."""
    s = small(layers(spark, sf))
    return raster.painted(raster.bands(s, "z", "ord"))


@query(f"""WITH {SMALL}, PX AS (SELECT image_id, layer_id, y, unnest(range(x0, x1)) AS x FROM R WHERE mode = 'image'), B AS (SELECT DISTINCT image_id, y, unnest(range(x0, x1)) AS x FROM R WHERE mode = 'surface')
    SELECT image_id, layer_id, count(*) AS pixels FROM PX ANTI JOIN B USING (image_id, y, x) GROUP BY ALL""")
def mask_subtract(spark: S, sf: str) -> DataFrame:
    s = small(layers(spark, sf))
    left = raster.subtract(raster.from_boxes(s.filter("mode = 'image'")), raster.union(raster.from_boxes(s.filter("mode = 'surface'"))))
    return left.groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


@query(f"""WITH {SMALL}, W AS (SELECT image_id, layer_id, x0 + q_ % 20 AS wx0, y0 AS wy0, x1 AS wx1, y1 - 1 AS wy1 FROM (SELECT S.*, L.q AS q_ FROM S JOIN L ON S.image_id = L.image_id AND S.ord = L.ord)),
    X AS (SELECT S.image_id, S.layer_id, (S.x1 - S.x0) * (S.y1 - S.y0) AS n, greatest(0, S.x1 - wx0) * greatest(0, S.y1 - 1 - S.y0) AS m FROM S JOIN W USING (image_id, layer_id)) SELECT image_id, layer_id, (CASE WHEN m < 0.35 * n THEN n ELSE m END)::BIGINT AS pixels FROM X""")
def guarded_masks(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    s = small(x).join(x.select("image_id", F.col("ord").alias("layer_id"), "q"), ["image_id", "layer_id"])
    windows = s.select("image_id", "layer_id", (F.col("x0") + F.col("q") % 20).alias("wx0"), F.col("y0").alias("wy0"), F.col("x1").alias("wx1"), (F.col("y1") - 1).alias("wy1"))
    return raster.guarded(raster.from_boxes(s), windows).groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


@query(f"""WITH {SMALL}, E AS (SELECT a.image_id, a.layer_id AS under_id, b.layer_id AS over_id, b.x0 - 3 AS x0, b.y0 - 3 AS y0, b.x1 + 3 AS x1, b.y1 + 3 AS y1 FROM S a JOIN S b ON a.image_id = b.image_id AND b.ord = a.ord + 1),
    X AS (SELECT S.image_id, S.layer_id, (least(S.x1, E.x1) - greatest(S.x0, E.x0)) * (least(S.y1, E.y1) - greatest(S.y0, E.y0)) AS pixels FROM S JOIN E ON S.image_id = E.image_id AND S.layer_id = under_id AND S.x0 < E.x1 AND E.x0 < S.x1 AND S.y0 < E.y1 AND E.y0 < S.y1) SELECT * FROM X""")
def repair_holes(spark: S, sf: str) -> DataFrame:
    s = small(layers(spark, sf))
    a, b = s.select("image_id", F.col("layer_id").alias("under_id")), s.select("image_id", F.col("layer_id").alias("over_id"), (F.col("layer_id") - 1).alias("under_id"))
    edges = a.join(b, ["image_id", "under_id"])
    return raster.holes(raster.from_boxes(s), edges, 3).groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


@query(f"WITH {SMALL} SELECT image_id, mode, count(*) AS n_masks, sum((x1 - x0) * (y1 - y0))::BIGINT AS area, min(x0) AS x0, max(y1) AS y1 FROM S GROUP BY ALL")
def mask_measures(spark: S, sf: str) -> DataFrame:
    s = small(layers(spark, sf))
    m = raster.measures(raster.from_boxes(s)).join(s.select("image_id", "layer_id", "mode"), ["image_id", "layer_id"])
    return m.groupBy("image_id", "mode").agg(F.count("*").alias("n_masks"), F.sum("area").alias("area"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


# ---- chunks, atlases, dense kernels, audit

_CHUNKS = f"""WITH RECURSIVE {LAYERS}, X AS (SELECT image_id, ord, (x1 - x0) * (y1 - y0) AS size FROM L),
    F AS (SELECT image_id, ord, size AS total, 0 AS chunk FROM X WHERE ord = 1 UNION ALL
        SELECT X.image_id, X.ord, CASE WHEN total > 0 AND total + size > 60000 THEN size ELSE total + size END, chunk + CASE WHEN total > 0 AND total + size > 60000 THEN 1 ELSE 0 END FROM F JOIN X ON X.image_id = F.image_id AND X.ord = F.ord + 1)
    SELECT image_id, ord, chunk FROM F"""


@query(_CHUNKS)
def atlas_chunking(spark: S, sf: str) -> DataFrame:
    return pack.chunked(layers(spark, sf).withColumn("size", geo.area()), "image_id", "ord", "size", 60000)


@query()
def atlas_shelf_pack(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).select("image_id", "ord", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    return x.groupBy("image_id").applyInArrow(pack.shelves(), pack.CELLS)


_COMPONENTS = f"""WITH RECURSIVE {SMALL}, G AS (SELECT image_id, (mode <> 'none')::BIGINT AS layer_id, ord AS k, x0, y0, x1, y1 FROM S),
    A AS (SELECT a.image_id, a.layer_id, a.k, b.k AS o FROM G a JOIN G b ON a.image_id = b.image_id AND a.layer_id = b.layer_id AND a.k <> b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
    reach AS (SELECT image_id, layer_id, k, k AS o FROM G UNION SELECT r.image_id, r.layer_id, r.k, A.o FROM reach r JOIN A ON A.image_id = r.image_id AND A.layer_id = r.layer_id AND A.k = r.o),
    C AS (SELECT image_id, layer_id, k, min(o) AS c FROM reach GROUP BY ALL), PX AS (SELECT DISTINCT image_id, layer_id, c, y, unnest(range(x0, x1)) AS x FROM (SELECT G.*, c, unnest(range(y0, y1)) AS y FROM G JOIN C USING (image_id, layer_id, k))),
    N AS (SELECT image_id, layer_id, c, count(*) AS pixels, min((y, x)) AS first FROM PX GROUP BY ALL) SELECT image_id, layer_id, row_number() OVER (PARTITION BY image_id, layer_id ORDER BY first) - 1 AS label, pixels FROM N"""


@query(_COMPONENTS)
def mask_components(spark: S, sf: str) -> DataFrame:
    runs = raster.coalesced(raster.from_boxes(small(layers(spark, sf)).withColumn("layer_id", F.when(F.col("mode") == "none", 0).otherwise(1).cast("long"))))
    labelled = runs.groupBy("image_id", "layer_id").applyInArrow(dense.components(), dense.LABELS)
    return labelled.groupBy("image_id", "layer_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


_FAR = " + ".join("({c} - c{k}{c}) * ({c} - c{k}{c})".replace("{c}", c) for c in "bgr")
_MEAN = ", ".join(f"coalesce(sum({c} * n) FILTER (near = {k}) / sum(n) FILTER (near = {k})::DOUBLE, any_value(c{k}{c})) AS c{k}{c}" for k in (0, 1) for c in "bgr")
_ROUND = "N{j} AS (SELECT *, CASE WHEN " + _FAR.replace("{k}", "0") + " <= " + _FAR.replace("{k}", "1") + " THEN 0 ELSE 1 END AS near FROM HC JOIN M{i} USING (label)), M{j} AS (SELECT label, " + _MEAN + " FROM N{j} GROUP BY 1)"
_ENDS = ", ".join(f"arg_min({c}, ({sign}(b + g + r), b, g, r))::DOUBLE AS c{k}{c}" for k, sign in ((0, ""), (1, "-")) for c in "bgr")
_FOUR = ", ".join(f"printf('%.4f', CASE near WHEN 0 THEN c0{c} ELSE c1{c} END)::DOUBLE AS {c}" for c in "bgr")


@query(f"""WITH {PIXELS}, HC AS (SELECT label, b, g, r, count(*) AS n FROM P GROUP BY ALL), M0 AS (SELECT label, {_ENDS} FROM HC GROUP BY 1), {", ".join(_ROUND.replace("{j}", str(k)).replace("{i}", str(k - 1)) for k in range(1, 11))},
    K AS (SELECT label, near, sum(n)::BIGINT AS n FROM N10 GROUP BY ALL), E AS (SELECT label, near, coalesce(n, 0) AS n FROM (SELECT label, unnest([0, 1]) AS near FROM M10) LEFT JOIN K USING (label, near))
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY n DESC, near) - 1 AS cluster, n, {_FOUR} FROM E JOIN M10 USING (label)""")
def region_two_means(spark: S, sf: str) -> DataFrame:
    m = pixels(spark, sf).groupBy("label", "b", "g", "r").agg(F.count("*").alias("n")).groupBy("label").applyInArrow(dense.two_means(), dense.MEANS)
    return m.select("label", "cluster", "n", *[geo.round_n(F.col(c), 4).alias(c) for c in "bgr"])


@query(f"""WITH {LAYERS}, {_OVER}, {_BEST}, N AS (SELECT image_id, under_id AS id, count(*) AS n FROM EDGE GROUP BY ALL), G AS (SELECT image_id, count(*) FILTER (n > 0 AND mode <> 'none') AS n_repair, count(*) AS n_layers, count(*) FILTER (mode = 'image') AS n_image FROM L LEFT JOIN N USING (image_id, id) GROUP BY 1),
    M AS (SELECT image_id, count(*) FILTER (margin < 0.15) AS n_ambiguous FROM O WHERE r = 1 GROUP BY 1) SELECT image_id, n_layers, n_image, n_repair, n_ambiguous FROM G JOIN M USING (image_id)""")
def quality_audit(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    repair = occlusion.needs_repair(x, occlusion.edges(x, touch=True)).groupBy("image_id").agg(F.count("*").alias("n_layers"), F.count_if(F.col("mode") == "image").alias("n_image"), F.count_if("needs_repair").alias("n_repair"))
    sure = scoring.best(_candidates(x)).groupBy("image_id").agg(F.count_if(F.col("margin") < 0.15).alias("n_ambiguous"))
    return repair.join(sure, "image_id")


# ---- prompts, manifests, points, splits


_ROUNDED = "regexp_replace(printf('%.4f', {v} / {n}::DOUBLE), '(\\.\\d+?)0+$', '\\1')"


@query(f"""WITH {LAYERS}, X AS (SELECT image_id, ord, '  ' || concat_ws(' | ', id, trim(kind || ' ' || mode), '[' || concat_ws(', ', {", ".join(_ROUNDED.format(v=v, n=n) for v, n in (("x0", W), ("y0", H), ("x1", W), ("y1", H)))}) || ']', printf('%.2f', q / 37.0::DOUBLE)) AS line FROM L)
    SELECT image_id, chr(10) || chr(10) || 'OCR regions (' || count(*)::VARCHAR || '), format id | text | bbox_norm | conf:' || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS block FROM X GROUP BY 1""")
def ocr_prompt_block(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf).withColumn("text", F.concat("kind", F.lit("\n"), "mode", F.lit("\n"))).withColumn("score", F.col("q") / 37.0)
    return gates.prompt_block(x, W, H)


@query(f"""WITH {LAYERS}, DUP AS (SELECT a.image_id, b.id AS loser, a.id AS keeper FROM L a JOIN L b ON a.image_id = b.image_id AND b.ord = a.ord + 1 AND a.q % 6 = 0 AND b.q % 6 <> 0),
    K AS (SELECT * FROM L WHERE q % 23 <> 0 AND NOT EXISTS (SELECT 1 FROM DUP WHERE DUP.image_id = L.image_id AND loser = L.id)), M AS (SELECT id, CASE WHEN q % 2 = 0 THEN 'surface' ELSE 'image-atlas' END AS method FROM L WHERE q % 4 <> 0),
    AKA AS (SELECT image_id, keeper AS id, string_agg(loser, ',' ORDER BY loser) AS aka FROM DUP GROUP BY ALL)
    SELECT K.image_id, K.id, row_number() OVER (PARTITION BY K.image_id ORDER BY K.z, K.id) AS position, method, aka FROM K LEFT JOIN M USING (id) LEFT JOIN AKA ON AKA.image_id = K.image_id AND AKA.id = K.id""")
def manifest_rows(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    a, b = x.filter("q % 6 = 0").alias("a"), x.filter("q % 6 <> 0").alias("b")
    dup = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("b.ord") == F.col("a.ord") + 1)).select("a.image_id", F.col("b.id").alias("loser"), F.col("a.id").alias("keeper"))
    log = x.filter("q % 4 <> 0").select("id", F.when(F.col("q") % 2 == 0, "surface").otherwise("image-atlas").alias("method"), F.lit(1).alias("ord"))
    log = log.unionByName(log.withColumn("ord", F.lit(2)).withColumn("method", F.lit("again")))
    return audit.manifest(x, log, dup, x.filter("q % 23 = 0").select("id"))


_POINTS = f"""{SMALL}, PT AS (SELECT S.image_id, layer_id, CASE WHEN q % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind, greatest(0, least({views.SMALL_W - 1}, x0 + q % 31 - 3)) AS px, greatest(0, least({views.SMALL_H - 1}, y0 + q % 13 - 1)) AS py, x0, y0, x1, y1 FROM S JOIN L ON S.image_id = L.image_id AND S.ord = L.ord)"""


@query(f"WITH {_POINTS.replace('S.image_id, layer_id', 'S.image_id, S.layer_id').replace('x0 + q', 'S.x0 + q').replace('y0 + q', 'S.y0 + q').replace(', x0, y0, x1, y1 FROM S', ', S.x0, S.y0, S.x1, S.y1 FROM S')} SELECT image_id, kind, count(*) AS n, count(*) FILTER (px >= x0 AND px < x1 AND py >= y0 AND py < y1) AS n_hit FROM PT GROUP BY ALL")
def points_in_masks(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    s = small(x)
    q = x.select("image_id", F.col("ord").alias("layer_id"), "q")
    p = s.join(q, ["image_id", "layer_id"]).select("image_id", "layer_id", F.when(F.col("q") % 2 == 0, "positive").otherwise("negative").alias("kind"), (F.col("x0") + F.col("q") % 31 - 3).alias("px"), (F.col("y0") + F.col("q") % 13 - 1).alias("py"))
    hits = raster.point_hits(p, raster.from_boxes(s), views.SMALL_W, views.SMALL_H)
    return hits.groupBy("image_id", "kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"))


@query(f"""WITH {SMALL}, D AS (SELECT DISTINCT image_id, l_suppkey % 95 AS y, l_partkey % 90 + 5 AS x FROM L), U AS (SELECT DISTINCT image_id, y, unnest(range(x0, x1)) AS x FROM R WHERE mode = 'image')
    SELECT image_id, count(*) FILTER (U.x IS NULL) AS n_bad FROM D LEFT JOIN U USING (image_id, y, x) GROUP BY 1""")
def lossless_check(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    differ = x.select("image_id", (F.col("l_suppkey") % 95).alias("y"), (F.col("l_partkey") % 90 + 5).alias("x")).distinct()
    return audit.lossless(differ, raster.union(raster.from_boxes(small(x).filter("mode = 'image'"))))


_FITS = "(w * h >= 3686400 AND greatest(w, h) <= 2800) OR (w * h < 3686400 AND greatest(ceil(w * sqrt(3686400 / (w * h)::DOUBLE)), ceil(h * sqrt(3686400 / (w * h)::DOUBLE)), ceil(3686400 / ceil(w * sqrt(3686400 / (w * h)::DOUBLE)))) <= 2800)"
_HALF = f"""SELECT id, unnest(CASE WHEN {_FITS} THEN [{{{{'a': x0, 'b': y0, 'c': x1, 'd': y1}}}}]
    WHEN w >= h THEN [{{{{'a': x0, 'b': y0, 'c': least(x1, x0 + w // 2 + ov), 'd': y1}}}}, {{{{'a': greatest(x0, x0 + w // 2 - ov), 'b': y0, 'c': x1, 'd': y1}}}}]
    ELSE [{{{{'a': x0, 'b': y0, 'c': x1, 'd': least(y1, y0 + h // 2 + ov)}}}}, {{{{'a': x0, 'b': greatest(y0, y0 + h // 2 - ov), 'c': x1, 'd': y1}}}}] END) AS s
    FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, greatest(8, least(64, least(x1 - x0, y1 - y0) // 8)) AS ov FROM {{t}})"""


@query(f"WITH {LAYERS}, H0 AS (SELECT id, x0, y0, x0 + (x1 - x0) * (1 + q % 40) AS x1, y0 + (y1 - y0) * (1 + q % 7) AS y1 FROM L), " + ", ".join(f"H{k}s AS ({_HALF.format(t=f'H{k - 1}')}), H{k} AS (SELECT id, s.a AS x0, s.b AS y0, s.c AS x1, s.d AS y1 FROM H{k}s)" for k in (1, 2, 3, 4)) + " SELECT * FROM H4")
def split_regions(spark: S, sf: str) -> DataFrame:
    x = layers(spark, sf)
    grown = lambda a, n: (F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * (1 + F.col("q") % n)).alias(f"{a}1")
    return raster.halves(x.select("id", "x0", "y0", grown("x", 40), grown("y", 7)))


_MATCHES = "M AS (SELECT image_id, l_linenumber AS layer_id, CASE WHEN (l_linenumber + image_id) % 3 = 0 THEN 0.8::DOUBLE + (q % 20) / 100.0::DOUBLE ELSE (q % 20) / 20.0::DOUBLE + 0.05::DOUBLE END AS value FROM L)"


def _matches(x: DataFrame) -> DataFrame:
    value = F.when((F.col("l_linenumber") + F.col("image_id")) % 3 == 0, F.lit(0.8) + F.col("q") % 20 / 100.0).otherwise(F.col("q") % 20 / 20.0 + 0.05)
    return x.select("image_id", F.col("l_linenumber").alias("layer_id"), value.alias("value"))


@query(f"""WITH {LAYERS}, {_MATCHES}, G AS (SELECT image_id, layer_id, count(*) AS n, count(*) FILTER (value >= 0.85) AS n_good, avg(value) FILTER (value >= 0.85) AS mean_good FROM M GROUP BY ALL)
    SELECT image_id, layer_id, n_good, floor(mean_good * 10000 + 0.001)::BIGINT AS mean_good FROM G WHERE n_good >= greatest(2, ceil(0.6 * n))""")
def template_consensus(spark: S, sf: str) -> DataFrame:
    return gates.consensus(_matches(layers(spark, sf))).withColumn("mean_good", F.floor(F.col("mean_good") * 10000 + 0.001))


from lamella.plans import audits, masks, routing  # noqa: E402, F401  they register theirs

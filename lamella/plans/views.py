"""The driver's tables as inputs of the layer analysis, in Spark and in SQL. 32 orders are an image, a line item a layer: images
are as large at any scale, and there are more of them the more data there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.sources.tables import table

#: Canvas of the small view, and of the large one.
SMALL_W, SMALL_H, W, H = 120, 110, 1100, 2100
_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, ord, id, z, mode, kind, box, source columns."""
    li = table(spark, sf, "lineitem").withColumn("image_id", F.floor(F.col("l_orderkey") / 32))
    li = li.withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy(*_ALL)).cast("long"))  # dealt by image_id once: what groups by it needs no more shuffle
    q = F.col("l_quantity").cast("int")
    x0, y0 = F.col("l_partkey") % 900, F.col("l_suppkey") * 23 % 1900
    return li.select(
        "image_id",
        "ord",
        F.concat(F.lit("layer_"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string")).alias("base_id"),
        F.col("l_linenumber").alias("z"),
        F.when(F.col("l_returnflag") == "N", "surface").when(F.col("l_returnflag") == "A", "image").otherwise("none").alias("mode"),
        F.when(F.col("l_linestatus") == "O", "icon").otherwise("badge").alias("kind"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 10 + 4 * q).alias("x1"),
        (y0 + 10 + 3 * q).alias("y1"),
        q.alias("q"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    ).withColumn("id", F.concat("base_id", F.lit("_"), F.col("ord").cast("string")))


LAYERS = f"""L0 AS (
    SELECT l_orderkey // 32 AS image_id, row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY {", ".join(_ALL)}) AS ord,
        'layer_' || (l_orderkey * 100 + l_linenumber)::VARCHAR AS base_id, l_linenumber AS z,
        CASE l_returnflag WHEN 'N' THEN 'surface' WHEN 'A' THEN 'image' ELSE 'none' END AS mode, CASE l_linestatus WHEN 'O' THEN 'icon' ELSE 'badge' END AS kind,
        l_partkey % 900 AS x0, l_suppkey * 23 % 1900 AS y0, l_partkey % 900 + 10 + 4 * l_quantity::INT AS x1, l_suppkey * 23 % 1900 + 10 + 3 * l_quantity::INT AS y1,
        l_quantity::INT AS q, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax
    FROM lineitem),
L AS (SELECT *, base_id || '_' || ord::VARCHAR AS id FROM L0)"""


def small(layer: DataFrame, *more: str) -> DataFrame:
    """The layers on a canvas of SMALL_W x SMALL_H, as masks need it; with more columns."""
    x0, y0 = F.col("l_partkey") % 90, F.col("l_suppkey") % 95
    return layer.select("image_id", F.col("ord").alias("layer_id"), "z", "ord", "mode", x0.alias("x0"), y0.alias("y0"), (x0 + 3 + F.col("q") % 24).alias("x1"), (y0 + 2 + F.col("q") % 11).alias("y1"), *more)


SMALL = LAYERS + """,
S AS (SELECT image_id, ord AS layer_id, z, ord, mode, l_partkey % 90 AS x0, l_suppkey % 95 AS y0, l_partkey % 90 + 3 + q % 24 AS x1, l_suppkey % 95 + 2 + q % 11 AS y1 FROM L),
R AS (SELECT image_id, layer_id, z, ord, mode, unnest(range(y0, y1)) AS y, x0, x1 FROM S)"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as images, their words as text detections."""
    d = table(spark, sf, "documents")
    w = d.select(F.col("doc_id").alias("image_id"), "lang", "n_chars", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    n = F.col("n_chars") + F.col("pos")
    return w.select("image_id", F.col("pos").cast("long").alias("ord"), F.when(n % 7 == 0, F.substring("word", 1, 1)).otherwise(F.col("word")).alias("text"), (n * 13 % 100 / 100).alias("score"), (n * 7 % 40).alias("w"), (n * 11 % 90).alias("h"), "lang")


TEXTS = """T0 AS (SELECT doc_id AS image_id, lang, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord, n_chars FROM documents),
T1 AS (SELECT *, n_chars + ord AS n FROM T0),
T AS (SELECT image_id, ord, CASE WHEN n % 7 = 0 THEN substr(word, 1, 1) ELSE word END AS text, (n * 13 % 100) / 100 AS score, n * 7 % 40 AS w, n * 11 % 90 AS h, lang FROM T1)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as pixels: three values of a vector are a pixel's channels; every third is a hole. Channels that the last
    pixel of a vector hasn't are 0."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    level = F.pmod(F.floor(F.abs(F.col("v").cast("double")) * 1000), F.lit(256))
    p = e.select("vec_id", "label", F.floor(F.col("pos") / 3).alias("k"), (F.col("pos") % 3).alias("c"), level.alias("v"))
    one = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    return p.groupBy("vec_id", "label", "k").agg(one(0).alias("b"), one(1).alias("g"), one(2).alias("r")).na.fill(0).withColumn("hole", (F.col("vec_id") + F.col("k")) % 3 == 0)


PIXELS = """P0 AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings),
P1 AS (SELECT vec_id, label, pos // 3 AS k, pos % 3 AS c, (floor(abs(e::DOUBLE) * 1000)::BIGINT) % 256 AS v FROM P0),
P2 AS (SELECT vec_id, label, k, max(CASE WHEN c = 0 THEN v END) AS b, max(CASE WHEN c = 1 THEN v END) AS g, max(CASE WHEN c = 2 THEN v END) AS r FROM P1 GROUP BY ALL),
P AS (SELECT *, (vec_id + k) % 3 = 0 AS hole FROM (SELECT vec_id, label, k, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM P2))"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of provider calls."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("value").alias("seconds"), ((F.col("event_id") % 5) >= 3).alias("accepted"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"))


ATTEMPTS = "A AS (SELECT event_id, ts, user_id AS key, event_type AS kind, value AS seconds, event_id % 5 >= 3 AS accepted, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"

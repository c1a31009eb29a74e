"""Reading and writing: tables by folder, JSON plans with a fixed schema, images by Spark's own reader, results by image."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = (
    "scene_summary string, background_repair struct<mode: string, reason: string>, text_corrections array<struct<text: string, bbox_norm: array<double>, confidence: double>>, raster_text_ids array<string>, "
    "queries array<struct<id: string, name: string, kind: string, role: string, element_repair_mode: string, parent_query_id: string, z_order: string, "
    "geometry_hints: array<struct<bbox_norm: array<double>, positive_points_norm: array<array<double>>, negative_points_norm: array<array<double>>>>>>, "
    "generated_by string, generated_at string, source string, ocr_ids_sent array<string>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written into the folder that driver and executors share (spark.checkpoint.dir; a temporary one only where it is unset on a local master) and read
    back: its plan is cut there, and it survives a lost executor."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan documents, one per file, whatever their layout; those that can't be read are rows of nulls. path has the file."""
    return spark.read.schema(PLAN).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.input_file_name())


def parsed(plan_text: DataFrame, column: str = "json") -> DataFrame:
    """Plan documents in a string column, as columns."""
    return plan_text.withColumn("plan", F.from_json(column, PLAN, {"mode": "PERMISSIVE"})).select(*[c for c in plan_text.columns if c != column], "plan.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (path), h, w, channels and row-major BGR bytes."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def with_overrides(defaults: DataFrame, overrides: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Defaults by key with what overrides say of the allowed columns; other columns of overrides are dropped."""
    known = [c for c in allowed if c in overrides.columns]
    o = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in known])
    out = defaults.join(o, key, "left")
    return out.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in known else F.col(c) for c in defaults.columns if c != key])


def inpaint_key(content: F.Column, mask: F.Column, prompt: F.Column, provider: F.Column, seed: F.Column) -> F.Column:
    """The name of a provider's answer in the cache: of what was sent (bytes of image and mask, prompt, provider), then provider and seed."""
    sent = F.md5(F.concat(F.coalesce(content, F.lit(b"")), F.coalesce(mask, F.lit(b"")), F.encode(F.coalesce(prompt, F.lit("")), "utf-8"), F.encode(provider, "utf-8")))
    return F.concat_ws("_", F.substring(sent, 1, 16), provider, seed.cast("string"))


def layer_list(spark: SparkSession, path: str) -> DataFrame:
    """id, area, bbox of the JSON list of layers that an earlier version left."""
    return spark.read.schema("id string, area long, bbox array<long>").option("multiLine", True).json(path)


def cached(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """What the cache has, and what is still to be done."""
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


def write_by_image(df: DataFrame, path: str, kind: str = "parquet", by: str | None = "image_id") -> None:
    """Over what was there before, a folder for each value of `by` (few files each: rows are dealt by it); none if by is None."""
    rows = df.repartition(by) if by else df
    out = rows.write.mode("overwrite").format(kind)
    (out.partitionBy(by) if by else out).save(path)

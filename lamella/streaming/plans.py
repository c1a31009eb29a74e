"""An extension: the stateless plan stages over a stream of plan documents, and windowed counts of provider calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources.tables import PLAN


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Queries of plan documents as they arrive, a row each."""
    plan = spark.readStream.schema(PLAN).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    q = plan.select("source", F.posexplode("queries").alias("ord", "q"))
    return q.select(F.col("source").alias("image_id"), "ord", "q.id", "q.kind", "q.role", F.col("q.element_repair_mode").alias("mode"), F.col("q.z_order").alias("z"), "q.parent_query_id", F.col("q.geometry_hints").alias("hints"))


def call_counts(calls: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Calls by kind and tumbling window; rows later than the watermark are left out, as Structured Streaming has it. Works on
    tables as on streams."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds")).select(F.col("window.start").alias("start"), "kind", "n", "seconds")

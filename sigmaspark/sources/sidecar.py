"""The XML file of edited tags beside an image, as a table (area, track, tag) and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "_id string, Track array<struct<_number:int, _VALUE:string>>"


def load(spark: SparkSession, path: str) -> DataFrame:
    areas = spark.read.format("xml").option("rowTag", "Area").schema(SCHEMA).load(path)
    rows = areas.select(F.col("_id").alias("area"), F.explode("Track").alias("t"))
    return rows.select("area", F.col("t._number").alias("track"), F.unbase64(F.trim("t._VALUE")).alias("tag"))


def save(tags: DataFrame, path: str) -> None:
    """One row per area, its tracks in order."""
    track = F.struct(F.col("track").alias("_number"), F.base64("tag").alias("_VALUE"))
    rows = tags.groupBy(F.col("area").alias("_id")).agg(F.array_sort(F.collect_list(track)).alias("Track"))
    rows.write.format("xml").option("rowTag", "Area").option("rootTag", "Tags").mode("overwrite").save(path)

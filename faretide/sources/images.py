"""Item -> image address map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_images(obs: DataFrame) -> DataFrame:
    """First http image seen for each hotel."""
    usable = obs.withColumn("image_url", F.trim("image_url")).filter(
        F.startswith("image_url", F.lit("http")) & (F.col("hotel_name") != "")
    )
    return usable.groupBy("hotel_name").agg(F.min_by("image_url", "seq").alias("image_url"))


def merge_image_map(existing: DataFrame, obs: DataFrame) -> DataFrame:
    """The existing map plus hotels it lacks; an existing entry is never replaced."""
    known = existing.select("hotel_name", "image_url")
    return known.unionByName(first_images(obs).join(known, "hotel_name", "left_anti"))


def with_images(items: DataFrame, images: DataFrame) -> DataFrame:
    """Items with their image. Both sides hold one row per hotel, so AQE picks the join."""
    return items.join(images.select("hotel_name", "image_url"), "hotel_name", "left")

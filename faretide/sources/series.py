"""Chart series of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide.functions.text import slugify
from faretide.functions.timestamps import minute_text
from faretide.plans.shape import running_total
from faretide.schema import KEY, ORDER


# Points of one row.
PART_POINTS = 100_000


def price_series(obs: DataFrame, tz: str = "UTC", max_points: int = PART_POINTS) -> DataFrame:
    """Ordered ``x`` (local minute) and ``y`` (price) arrays of each item, in parts of ``max_points`` points.

    Part k holds the points from number k * ``max_points`` on, so parts count from 0, follow each other in
    order, and are the same in every run; no row or task holds an unbounded series.
    """
    placed = running_total(obs.select(*KEY, "price", *ORDER), F.lit(1), KEY, ORDER, "_position")
    parts = placed.withColumn("part", F.floor((F.col("_position") - 1) / max_points).cast("int"))
    points = F.array_sort(F.collect_list(F.struct(*ORDER, "price")))
    return (
        parts.groupBy(*KEY, "part")
        .agg(points.alias("points"))
        .select(
            "dataset",
            "hotel_name",
            slugify(F.col("hotel_name")).alias("slug"),
            "part",
            F.transform("points", lambda p: minute_text(p["observed_at"], tz)).alias("x"),
            F.transform("points", lambda p: p["price"]).alias("y"),
        )
    )

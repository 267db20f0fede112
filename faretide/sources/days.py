"""Tables derived from the observation table day by day, in which late rows replace their days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretide.plans.shape import attach
from faretide.sources.observations import read_table

# Up to so many days are named one by one to the scan of the rows.
NAMED_DAYS = 1000


def near_days(table: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the table's partitions that may hold these days; a day of slack, as partitions may follow another zone."""
    if "obs_date" not in table.columns:
        return table
    named = [r["day"] for r in days.select("day").distinct().limit(NAMED_DAYS + 1).collect()]
    if len(named) > NAMED_DAYS:
        low, high = days.agg(F.min("day"), F.max("day")).first()
        return table.filter(F.col("obs_date").between(F.date_sub(F.lit(low), 1), F.date_add(F.lit(high), 1)))
    near = [F.date_add(F.lit(d), k) for d in named for k in (-1, 0, 1)]
    return table.filter(F.col("obs_date").isin(*near) if near else F.lit(False))


def store_days(
    spark: SparkSession,
    table_path: str,
    path: str,
    build: Callable[[DataFrame], DataFrame],
    fresh: DataFrame | None = None,
) -> None:
    """Write ``build`` of the observation table, or only of the (dataset, day) pairs that ``fresh`` rows touch.

    ``build`` gives rows with ``dataset`` and ``day``, each from the observations of that day alone (a day of the session's
    zone). Other days are neither read nor written, and a repeated call writes the same rows again.
    """
    table = read_table(spark, table_path).filter("observed_at is not null")
    if fresh is not None:
        days = fresh.filter("observed_at is not null").select("dataset", F.to_date("observed_at").alias("day")).distinct()
        dated = near_days(table, days).withColumn("day", F.to_date("observed_at"))
        table = attach(dated, days, ["dataset", "day"], "left_semi")
    (
        build(table)
        .withColumn("stored_day", F.col("day"))
        .hint("rebalance", "dataset", "stored_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "stored_day")
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("stored_day")

"""Windowed statistics and runs of a stream; repair of days touched by late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import exact, finite, mean_of_sums, money_mean
from faretide.operators.stats import daily_stats
from faretide.plans.shape import attach
from faretide.sources.observations import read_table
from faretide.streaming.core import watermarked


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("offers"),
        money_mean(F.col("price")).alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    ]


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "offers",
        "mean_price",
        "min_price",
        "max_price",
    )


def stats_stream(
    stream: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Price statistics per tumbling or sliding window of every dataset.

    Sliding windows are put together from panes of one slide each, so a row enters one pane and not
    every window it falls in. The width is a multiple of the slide.
    """
    price = exact(F.col("price"))
    panes = (
        watermarked(stream.withColumn("price", finite(F.col("price"))), delay)
        .groupBy("dataset", F.window("observed_at", slide or width).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("offers"),
            F.sum(price).alias("_sum"),
            F.count(price).alias("_n"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
        )
    )
    if slide:
        panes = panes.groupBy("dataset", F.window(F.col("window"), width, slide).alias("window")).agg(
            F.sum("offers").alias("offers"),
            F.sum("_sum").alias("_sum"),
            F.sum("_n").alias("_n"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
        )
    return _flat(panes.withColumn("mean_price", mean_of_sums(F.col("_sum"), F.col("_n"))), "dataset")


def session_stream(stream: DataFrame, gap: str = fv.RUN_GAP, delay: str = "1 hour") -> DataFrame:
    """Runs as session windows; the window ends one gap after the last row.

    Each task merges the sessions of its own rows before the shuffle, so a dataset with most of the rows sends
    its sessions and not its rows to the task that joins them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    grouped = watermarked(stream.withColumn("price", finite(F.col("price"))), delay).groupBy(
        "dataset", F.session_window("observed_at", gap).alias("window")
    )
    return _flat(grouped.agg(*_measures()), "dataset")


def change_window_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First and last price of every item per 24-hour window sliding by the hour, from hourly panes."""
    order = F.struct("observed_at", "seq")
    panes = (
        watermarked(stream, delay)
        .groupBy("dataset", "hotel_name", F.window("observed_at", "1 hour").alias("window"))
        .agg(
            F.min_by("price", order).alias("first_price"),
            F.max_by("price", order).alias("last_price"),
            F.min("observed_at").alias("first_at"),
            F.max("observed_at").alias("last_at"),
            F.count(F.lit(1)).alias("offers"),
        )
    )
    ends = panes.groupBy(
        "dataset", "hotel_name", F.window(F.col("window"), "24 hours", "1 hour").alias("window")
    ).agg(
        F.min_by("first_price", "first_at").alias("first_price"),
        F.max_by("last_price", "last_at").alias("last_price"),
        F.sum("offers").alias("offers"),
    )
    return ends.select(
        "dataset",
        "hotel_name",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "first_price",
        "last_price",
        (F.col("last_price") - F.col("first_price")).alias("price_change"),
        "offers",
    )


def repaired_days(table: DataFrame, late: DataFrame) -> DataFrame:
    """Daily statistics recomputed for just the (dataset, day) partitions that late rows touch."""
    touched = late.select("dataset", "obs_date").distinct()
    return daily_stats(attach(table, touched, ["dataset", "obs_date"], "left_semi"))


def repair_daily_stats(spark: SparkSession, table_path: str, stats_path: str, late: DataFrame) -> None:
    """Rewrite the statistics of the touched days and leave all other days alone."""
    (
        repaired_days(read_table(spark, table_path), late)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "day")
        .parquet(stats_path)
    )

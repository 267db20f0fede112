"""JSON documents: search definitions, schedules, comparison results, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretide import fixed_values as fv
from faretide.functions.money import money_mean
from faretide.functions.timestamps import iso_text
from faretide.functions.urls import duration_range, price_limit, trip_window, url_filters
from faretide.operators.ranking import top_offers
from faretide.plans.quantiles import exact_quantiles

SEARCH_DEFINITION = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("max_price_threshold", T.LongType()),
        T.StructField("wait_timeout", T.LongType()),
        T.StructField("max_retries", T.LongType()),
        T.StructField("max_offers", T.LongType()),
        T.StructField("retry_delay", T.LongType()),
        T.StructField("data_dir", T.StringType()),
        T.StructField("output_data_file", T.StringType()),
        T.StructField("charts_dir", T.StringType()),
        T.StructField("report_file", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def read_search_definitions(
    spark: SparkSession,
    paths: str | Sequence[str],
    defaults: Mapping[str, object] | None = None,
    multiline: bool = True,
) -> DataFrame:
    """One row per search definition, with the facts its URL carries."""
    raw = spark.read.schema(SEARCH_DEFINITION).option("multiLine", multiline).json(paths)
    filled = raw.select(
        *[
            F.coalesce(F.col(c), F.lit((defaults or {}).get(c)).cast(raw.schema[c].dataType)).alias(c)
            for c in raw.columns
        ]
    )
    return filled.select(
        "*",
        url_filters(F.col("url")).alias("filters"),
        price_limit(F.col("url")).alias("price_limit"),
        trip_window(F.col("url")).alias("trip_window"),
        duration_range(F.col("url")).alias("duration_range"),
    )


def overlay(values: Column, defaults: Mapping[str, str] = fv.SCHEDULE_DEFAULTS) -> Column:
    """A settings map laid over the defaults: given keys win, the rest stays."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(values, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(values, F.from_json(F.lit("{}"), "map<string,string>")))


def summary_document(obs: DataFrame, n: int = 5, analysis_date: str | None = None) -> DataFrame:
    """One row per dataset: counts, date range, price statistics and the cheapest offers."""
    totals = obs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_offers"),
        F.count_distinct("hotel_name").alias("unique_hotels"),
        F.struct(
            iso_text(F.min("observed_at")).alias("start"), iso_text(F.max("observed_at")).alias("end")
        ).alias("date_range"),
        money_mean(F.col("price")).alias("mean"),
        F.min("price").alias("min"),
        F.max("price").alias("max"),
        F.stddev_samp("price").alias("std"),
    )
    median = exact_quantiles(obs, ["dataset"], "price", {"median": 0.5})
    # At most n rows per dataset reach the list.
    cheapest = (
        top_offers(obs, n)
        .groupBy("dataset")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "hotel_name", "price", "dates"))),
                lambda r: F.struct(
                    r["hotel_name"].alias("hotel_name"), r["price"].alias("price"), r["dates"].alias("dates")
                ),
            ).alias("top_cheap_offers")
        )
    )
    joined = totals.join(median, "dataset", "left").join(cheapest, "dataset", "left")
    return joined.select(
        "dataset",
        F.lit(analysis_date).cast("string").alias("analysis_date"),
        "total_offers",
        "unique_hotels",
        "date_range",
        F.struct("mean", "median", "min", "max", "std").alias("price_stats"),
        "top_cheap_offers",
    )


def write_document(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    df.write.mode("errorifexists").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)

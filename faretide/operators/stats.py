"""Statistics of prices: per dataset, per day, per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretide.functions.money import (
    exact,
    finite,
    mean_of_sums,
    money_mean,
    pct_change,
    trend_colour,
    trend_status,
)
from faretide.functions.timestamps import obs_day
from faretide.operators.ranking import first_by, last_by, rank_per, top_offers
from faretide.plans.quantiles import exact_quantiles
from faretide.plans.shape import attach
from faretide.schema import KEY, ORDER


def _priced(obs: DataFrame) -> DataFrame:
    """Rows with finite prices or none, so that all measures leave out the same ones."""
    return obs.withColumn("price", finite(F.col("price")))


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("offers"),
        F.count_distinct("hotel_name").alias("hotels"),
        money_mean(F.col("price")).alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    ]


def kpis(obs: DataFrame) -> DataFrame:
    """Rows, distinct items, mean, minimum and maximum price of every dataset."""
    return _priced(obs).groupBy("dataset").agg(*_totals())


def approx_kpis(obs: DataFrame, rsd: float = 0.01) -> DataFrame:
    """``kpis`` with a sketched item count, for inputs where one shuffle of all items is too much."""
    return _priced(obs).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("offers"),
        F.approx_count_distinct("hotel_name", rsd).alias("hotels"),
        money_mean(F.col("price")).alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def describe_prices(obs: DataFrame) -> DataFrame:
    """``kpis`` plus median, sample deviation and the first and last time."""
    obs = _priced(obs)
    totals = obs.groupBy("dataset").agg(
        *_totals(),
        F.stddev_samp("price").alias("std_price"),
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
    )
    median = exact_quantiles(obs, ["dataset"], "price", {"median_price": 0.5})
    return totals.join(median, "dataset", "left")


def daily_stats(obs: DataFrame, tz: str = "UTC") -> DataFrame:
    """Mean, minimum, maximum and number of prices per local day."""
    return _priced(obs).groupBy("dataset", obs_day(F.col("observed_at"), tz).alias("day")).agg(
        money_mean(F.col("price")).alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("price").alias("offers"),
    )


def daily_distribution(obs: DataFrame, tz: str = "UTC") -> DataFrame:
    """Box-plot numbers per day: quartiles, whisker ends and the count beyond them."""
    dated = _priced(obs).select("dataset", obs_day(F.col("observed_at"), tz).alias("day"), "price")
    keys = ["dataset", "day"]
    boxes = exact_quantiles(dated, keys, "price", {"q1": 0.25, "median_price": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("price") >= F.col("q1") - reach) & (F.col("price") <= F.col("q3") + reach)
    return (
        dated.filter(F.col("price").isNotNull())
        .join(boxes, keys, "left")
        .groupBy(*keys, "q1", "median_price", "q3")
        .agg(
            F.min(F.when(inside, F.col("price"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("price"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
            F.count(F.lit(1)).alias("offers"),
        )
    )


def offers_per_item(obs: DataFrame, n: int = 20) -> DataFrame:
    """The items with most rows in every dataset."""
    counts = obs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("offers"))
    return rank_per(counts, ["dataset"], [F.desc("offers"), F.asc("hotel_name")], n)


def cheapest(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cheapest row of every key; the earliest row wins ties."""
    return first_by(obs.filter(finite(F.col("price")).isNotNull()), keys or KEY, ["price", "seq"])


def latest(obs: DataFrame) -> DataFrame:
    """Newest row of every item."""
    return last_by(obs, KEY, ORDER)


def _profile(obs: DataFrame) -> DataFrame:
    order = F.struct(*ORDER)
    return _priced(obs).groupBy(*KEY).agg(
        F.min_by("price", order).alias("first_price"),
        F.max_by("price", order).alias("last_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        money_mean(F.col("price")).alias("avg_price"),
        F.count(F.lit(1)).alias("records"),
        F.min("observed_at").alias("first_date"),
        F.max("observed_at").alias("last_date"),
    )


def _with_change(profile: DataFrame) -> DataFrame:
    last, first = F.col("last_price"), F.col("first_price")
    return profile.withColumn("price_change", last - first).withColumn(
        "price_change_pct", pct_change(last, first)
    )


def first_last_change(obs: DataFrame, min_records: int = 2) -> DataFrame:
    """Change from the first to the last price of every item seen often enough."""
    order = F.struct(*ORDER)
    ends = obs.groupBy(*KEY).agg(
        F.min_by("price", order).alias("first_price"),
        F.max_by("price", order).alias("last_price"),
        F.count(F.lit(1)).alias("records"),
    )
    return _with_change(ends.filter(F.col("records") >= min_records))


def since_start(obs: DataFrame) -> DataFrame:
    """Change since the first sighting; unknown when that price was zero."""
    ends = first_last_change(obs, 1)
    return ends.withColumn(
        "price_change_pct", pct_change(F.col("last_price"), F.col("first_price"), on_zero=None)
    ).withColumn("price_change", F.when(F.col("price_change_pct").isNotNull(), F.col("price_change")))


def most_observed(obs: DataFrame, n: int = 10) -> DataFrame:
    """First-to-last changes of the items with most rows."""
    return rank_per(first_last_change(obs), ["dataset"], [F.desc("records"), F.asc("hotel_name")], n)


def watched_items(obs: DataFrame, n: int = 15) -> DataFrame:
    """Items among the n cheapest rows of their dataset, so at most n per dataset."""
    return top_offers(obs, n).select(*KEY).distinct()


def watchlist(obs: DataFrame, n: int = 15) -> DataFrame:
    """Price history summary of the items among the n cheapest rows."""
    rows = attach(obs, watched_items(obs, n), KEY, "left_semi")
    listed = _with_change(_profile(rows).filter(F.col("records") >= 2))
    return listed.withColumn("status", trend_status(F.col("price_change"))).withColumn(
        "status_color", trend_colour(F.col("price_change"))
    )


def item_stats(obs: DataFrame) -> DataFrame:
    """Price history summary of every item."""
    return _with_change(_profile(obs))


def price_histogram(obs: DataFrame, buckets: int = 20) -> DataFrame:
    """Rows per equal-width price bucket of every dataset; the top edge belongs to the last bucket."""
    obs = _priced(obs)
    edges = obs.groupBy("dataset").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    binned = attach(obs.select("dataset", "price"), edges, ["dataset"])
    width = (F.col("high") - F.col("low")) / F.lit(buckets)
    bucket = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("price") - F.col("low")) / width) + 1, F.lit(buckets))
    )
    return (
        binned.filter(F.col("price").isNotNull())
        .groupBy("dataset", bucket.cast("bigint").alias("bucket"), "low", "high")
        .agg(F.count(F.lit(1)).alias("offers"))
        .select(
            "dataset",
            "bucket",
            (F.col("low") + (F.col("bucket") - 1) * width).alias("bucket_from"),
            (F.col("low") + F.col("bucket") * width).alias("bucket_to"),
            "offers",
        )
    )


def kpi_rollup(obs: DataFrame) -> DataFrame:
    """Totals per dataset and day, per dataset, and overall (null keys), in one pass.

    Days are summed first, so the rollup expands day rows and not observations.
    """
    obs, amount = _priced(obs), exact(F.col("price"))
    days = obs.groupBy("dataset", obs_day(F.col("observed_at")).alias("day")).agg(
        F.sum(amount).alias("_sum"),
        F.count(amount).alias("_n"),
        F.min("price").alias("_min"),
        F.max("price").alias("_max"),
    )
    return (
        days.rollup("dataset", "day")
        .agg(
            F.sum("_n").alias("offers"),
            mean_of_sums(F.sum("_sum"), F.sum("_n")).alias("mean_price"),
            F.min("_min").alias("min_price"),
            F.max("_max").alias("max_price"),
        )
    )


def run_status_summary(status: DataFrame) -> DataFrame:
    """Totals over a table of (dataset, status, message) rows, with the failure messages."""
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def run_failures(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status") == "error").select("dataset", "message")

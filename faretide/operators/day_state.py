"""Daily state from which distributions and item counts of any range of days follow.

Two stored tables (see ``sources.days``), both far smaller than the observations:

* price counts: how often each price was seen on each day of a dataset. Means, deviations, exact quantiles and box plots of a
  day or of many days are sums over counts.
* day totals: sums per dataset and day, with a HyperLogLog sketch of the items. Sketches merge, so distinct items of any
  level come from days within a known error; exact counts come from the days' item lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretide.functions.money import exact, finite, mean_of_sums
from faretide.plans.quantiles import position_of
from faretide.plans.shape import attach, running_total

# Logarithm of the number of buckets of a sketch: a standard error of about 0.8 %, 8 kB a day.
SKETCH_BITS = 14
BOX = {"q1": 0.25, "median_price": 0.5, "q3": 0.75}


def _day() -> Column:
    return F.to_date("observed_at").alias("day")


def price_counts(obs: DataFrame) -> DataFrame:
    """``dataset, day, price, offers, first_seen, last_seen``: one row per price of a day; missing prices are one row."""
    return obs.groupBy("dataset", _day(), finite(F.col("price")).alias("price")).agg(
        F.count(F.lit(1)).alias("offers"),
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
    )


def item_days(obs: DataFrame) -> DataFrame:
    """``dataset, day, hotel_name``: the items of each day, each once."""
    return obs.select("dataset", _day(), "hotel_name").distinct()


def day_totals(obs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Sums of prices per dataset and day, with a sketch of the items."""
    price = finite(F.col("price"))
    return obs.groupBy("dataset", _day()).agg(
        F.sum(exact(price)).alias("amount"),
        F.count(price).alias("offers"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.hll_sketch_agg("hotel_name", bits).alias("items"),
    )


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of counted prices; a key with very many prices is numbered in range blocks."""
    keys = list(keys)
    merged = counts.filter("price is not null").groupBy(*keys, "price").agg(F.sum("offers").alias("_n"))
    totals = merged.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    upto = attach(running_total(merged, "_n", keys, ["price"], "_upto"), totals, keys, "inner")
    found, named = [], []
    for name, p in probabilities.items():
        below, fraction = position_of(p)
        found.append(F.min(F.when(F.col("_upto") > below, F.col("price"))).alias(f"_lo_{name}"))
        found.append(F.min(F.when(F.col("_upto") > below + F.ceil(fraction), F.col("price"))).alias(f"_hi_{name}"))
        found.append(F.first(fraction).alias(f"_part_{name}"))
        lo, hi, part = (F.col(f"_{c}_{name}") for c in ("lo", "hi", "part"))
        named.append((lo * (1 - part) + hi * part).alias(name))
    return upto.groupBy(*keys).agg(*found).select(*keys, *named)


def describe_counts(counts: DataFrame, items: DataFrame) -> DataFrame:
    """``stats.describe_prices`` of the days that ``counts`` and ``items`` (see ``item_days``) hold."""
    price, n = F.col("price"), F.col("offers")
    totals = counts.groupBy("dataset").agg(
        F.sum(n).alias("_rows"),
        F.sum(F.when(price.isNotNull(), n)).alias("_n"),
        # A product of decimals keeps all places of the price; counts of a price have up to ten digits.
        F.sum(exact(price) * n.cast("decimal(10,0)")).alias("_amount"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    totals = totals.withColumn("mean_price", mean_of_sums(F.col("_amount"), F.col("_n")))
    # Deviations from the mean, as the difference of two large sums would lose digits.
    about = attach(counts.filter("price is not null"), totals.select("dataset", "mean_price"), ["dataset"])
    square = F.sum(n * (price - F.col("mean_price")) * (price - F.col("mean_price")))
    spread = about.groupBy("dataset").agg(square.alias("_square"))
    hotels = items.groupBy("dataset").agg(F.count_distinct("hotel_name").alias("hotels"))
    medians = quantiles_of_counts(counts, ["dataset"], {"median_price": 0.5})
    joined = totals.join(spread, "dataset", "left").join(hotels, "dataset", "left").join(medians, "dataset", "left")
    return joined.select(
        "dataset",
        F.col("_rows").alias("offers"),
        F.coalesce("hotels", F.lit(0).cast("long")).alias("hotels"),
        "mean_price",
        "min_price",
        "max_price",
        F.when(F.col("_n") > 1, F.sqrt(F.col("_square") / (F.col("_n") - 1))).alias("std_price"),
        "first_seen",
        "last_seen",
        "median_price",
    )


def distribution_of_counts(counts: DataFrame) -> DataFrame:
    """``stats.daily_distribution`` from price counts."""
    keys = ["dataset", "day"]
    boxes = quantiles_of_counts(counts, keys, BOX)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("price") >= F.col("q1") - reach) & (F.col("price") <= F.col("q3") + reach)
    rows = attach(counts.filter("price is not null"), boxes, keys, "inner")
    return rows.groupBy(*keys, *BOX).agg(
        F.min(F.when(inside, F.col("price"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("price"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("offers"))), F.lit(0).cast("long")).alias("outliers"),
        F.sum("offers").alias("offers"),
    )


def item_rollup(totals: DataFrame) -> DataFrame:
    """``stats.kpi_rollup`` with the number of distinct items of each level, from day totals.

    ``items`` is the estimate of the merged sketches; its standard error is about 1.04 / sqrt(2^bits).
    """
    return totals.rollup("dataset", "day").agg(
        F.sum("offers").alias("offers"),
        mean_of_sums(F.sum("amount"), F.sum("offers")).alias("mean_price"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.hll_sketch_estimate(F.hll_union_agg("items")).alias("items"),
    )


def exact_item_rollup(items: DataFrame) -> DataFrame:
    """``dataset, day, items``: exact distinct items per day, per dataset and over all, from the days' item lists.

    The same name in two datasets is one item at the highest level, as in the sketches.
    """
    days = items.groupBy("dataset", "day").agg(F.count_distinct("hotel_name").alias("items"))
    sets = items.groupBy("dataset").agg(F.count_distinct("hotel_name").alias("items"))
    whole = items.agg(F.count_distinct("hotel_name").alias("items"))
    none = F.lit(None)
    return days.unionByName(sets.withColumn("day", none.cast("date"))).unionByName(
        whole.withColumn("dataset", none.cast("string")).withColumn("day", none.cast("date"))
    )

"""The same items from other departure airports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import savings, savings_pct
from faretide.functions.text import first_filled, normalize_dates, normalize_text
from faretide.functions.urls import airport_name, departure_from_url, destination_slug, link_or
from faretide.operators.filters import under_cap
from faretide.operators.ranking import first_by
from faretide.plans.shape import attach
from faretide.schema import KEY

ITEM = ("hotel_name",)


def _best(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_by(df.filter(F.col("price").isNotNull()), list(keys), ["price", "seq"])


def missing_in_base(
    base: DataFrame, other: DataFrame, cap: float | None = fv.PRICE_CAP, keys: Sequence[str] = ITEM
) -> DataFrame:
    """Cheapest row of each item that only ``other`` has, up to the price cap.

    Both sides are reduced to one row per item before they meet.
    """
    best = _best(other if cap is None else under_cap(other, cap), keys)
    return best.join(base.select(*keys).distinct(), list(keys), "left_anti")


_TAKEN = {
    "departure_airport": "best_departure_airport",
    "offer_url": "best_offer_url",
    "dates": "best_dates",
    "duration": "best_duration",
}


def cheaper_alternatives(
    base: DataFrame, other: DataFrame, keys: Sequence[str] = ITEM, taken: Mapping[str, str] = _TAKEN
) -> DataFrame:
    """Items whose lowest price in ``other`` beats their lowest price in ``base``.

    Both sides go tagged through one aggregate, so they are shuffled once and only after their partial results.
    Every offer passes a sort with what is ``taken`` of it (column -> name in the result): where links and texts are
    made of narrow columns, take those and make the texts of the chosen offers.
    """
    keys = list(keys)
    taken = {c: name for c, name in taken.items() if c in other.columns}
    offer = F.struct("price", "seq", *[c for c in taken if c != "seq"])
    # Items without a name have no counterpart.
    priced = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "price")])
    sides = base.filter(priced).select(*keys, F.col("price").alias("_base")).unionByName(
        other.filter(priced).select(*keys, offer.alias("_offer")), allowMissingColumns=True
    )
    lowest = sides.groupBy(*keys).agg(F.min("_base").alias("base_price"), F.min("_offer").alias("_best"))
    named = [F.col("_best.price").alias("best_other_price"), *[F.col(f"_best.{c}").alias(n) for c, n in taken.items()]]
    joined = lowest.select(*keys, "base_price", *named).filter(F.col("best_other_price") < F.col("base_price"))
    base_price, best_price = F.col("base_price"), F.col("best_other_price")
    return joined.withColumn("savings", savings(base_price, best_price)).withColumn(
        "savings_percent", savings_pct(base_price, best_price)
    )


def item_sets(base: DataFrame, other: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """Every item of either side with the sides that have it."""
    keys = list(keys)
    sides = (
        base.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_o"))
        .unionByName(other.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_o")))
        .groupBy(*keys)
        .agg(F.max("_b").alias("_b"), F.max("_o").alias("_o"))
    )
    return sides.select(
        *keys, (F.col("_b") == 1).alias("in_base"), (F.col("_o") == 1).alias("in_other")
    )


def items_only_in(df: DataFrame, other: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    return df.select(*keys).subtract(other.select(*keys))


def items_in_both(df: DataFrame, other: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    return df.select(*keys).intersect(other.select(*keys))


def comparison_summary(
    base: DataFrame, other: DataFrame, cap: float = fv.PRICE_CAP, keys: Sequence[str] = ITEM
) -> DataFrame:
    """Counters of one comparison.

    ``missing_count`` counts all items that only ``other`` has and
    ``missing_under_cap_count`` those with an offer up to the cap.
    """
    keys = list(keys)
    price_b = F.when(F.col("_side") == "b", F.col("price"))
    price_o = F.when(F.col("_side") == "o", F.col("price"))
    sides = base.select(*keys, "price", F.lit("b").alias("_side")).unionByName(
        other.select(*keys, "price", F.lit("o").alias("_side"))
    )
    items = sides.groupBy(*keys).agg(
        F.bool_or(F.col("_side") == "b").alias("_in_b"),
        F.bool_or(F.col("_side") == "o").alias("_in_o"),
        F.min(price_b).alias("_min_b"),
        F.min(price_o).alias("_min_o"),
    )
    only_other = F.col("_in_o") & ~F.col("_in_b")
    return items.agg(
        F.count_if(F.col("_in_b")).alias("base_items_count"),
        F.count_if(F.col("_in_o")).alias("other_items_count"),
        F.count_if(only_other).alias("missing_count"),
        F.count_if(only_other & (F.col("_min_o") <= cap)).alias("missing_under_cap_count"),
        F.count_if(F.col("_min_o") < F.col("_min_b")).alias("cheaper_alternatives_count"),
    )


def trip_key(df: DataFrame) -> DataFrame:
    """Add the comparable forms of name and trip dates, and the departure airport."""
    airport = [F.col("from_airport")] if "from_airport" in df.columns else []
    return df.select(
        "*",
        normalize_text(F.col("hotel_name")).alias("hotel_norm"),
        normalize_dates(F.col("dates")).alias("dates_norm"),
        first_filled(
            *airport, airport_name(departure_from_url(F.col("url"))), F.lit(fv.OTHER_CITY)
        ).alias("airport"),
    )


def cheapest_per_airport(obs: DataFrame) -> DataFrame:
    """Cheapest row per item, trip dates and airport."""
    return _best(trip_key(obs), ["dataset", "hotel_norm", "dates_norm", "airport"])


def cheaper_same_trip(
    obs: DataFrame, current: DataFrame, max_alternatives: int | None = None
) -> DataFrame:
    """Lower prices of the same item and trip dates from other airports.

    ``current`` holds one row per item with its price and ``current_airport``.
    Offers are reduced to one row per airport before the join, so a popular
    item adds no more rows than it has airports.
    """
    trip = ["dataset", "hotel_norm", "dates_norm"]
    used = ["dataset", "hotel_name", "dates", "price", "seq", "offer_url", "url"]
    used += [c for c in ("from_airport",) if c in obs.columns]
    alternatives = cheapest_per_airport(obs.select(*used)).select(
        *trip,
        "airport",
        F.col("price").alias("alt_price"),
        link_or(F.col("offer_url"), F.col("url")).alias("alt_url"),
    )
    asked = current.select(
        "dataset",
        "hotel_name",
        normalize_text(F.col("hotel_name")).alias("hotel_norm"),
        normalize_dates(F.col("dates")).alias("dates_norm"),
        F.col("price").alias("current_price"),
        first_filled(F.col("current_airport"), F.lit(fv.BASE_AIRPORT)).alias("current_airport"),
    )
    found = asked.join(alternatives, trip).filter(
        (F.col("alt_price") < F.col("current_price")) & (F.col("airport") != F.col("current_airport"))
    )
    saved = found.select(
        "dataset",
        "hotel_name",
        "dates_norm",
        "current_price",
        "airport",
        "alt_price",
        savings(F.col("current_price"), F.col("alt_price")).alias("savings"),
        savings_pct(F.col("current_price"), F.col("alt_price")).alias("savings_percent"),
        "alt_url",
    )
    if max_alternatives is None:
        return saved
    order = Window.partitionBy("dataset", "hotel_name", "dates_norm").orderBy("alt_price", "airport")
    return (
        saved.withColumn("_pos", F.row_number().over(order))
        .filter(F.col("_pos") <= max_alternatives)
        .drop("_pos")
    )


def same_destination_and_dates(other: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of ``other`` whose destination and whose trip dates both occur in ``base``."""

    slug = F.coalesce(
        F.nullif(destination_slug(F.col("offer_url")), F.lit("")), destination_slug(F.col("url"))
    ).alias("_slug")
    slugs = base.select(slug).filter(F.col("_slug") != "").distinct()

    def spellings(df: DataFrame) -> DataFrame:
        norm = normalize_dates(F.col("dates")).alias("_dates")
        return df.select("dates").distinct().select("dates", norm).filter(F.col("_dates").isNotNull())

    # Few spellings serve many rows, so they are normalised once each and rows match by spelling.
    matching = spellings(other).join(spellings(base).select("_dates"), "_dates", "left_semi")
    # Places and days are few and each is that of very many rows, so the rows stay where they are.
    at_place = attach(other.select("*", slug), slugs, ["_slug"], "left_semi").drop("_slug")
    return attach(at_place, matching.select("dates"), ["dates"], "left_semi").select(*other.columns)


def alternatives_for_items(items: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Items with their cheaper alternative, kept only if it beats the item's latest price.

    Items of several datasets match within their own where both sides tell it.
    """
    keys = [c for c in KEY if c in items.columns and c in alternatives.columns]
    alt = alternatives.select(
        *keys,
        F.col("best_other_price").alias("_alt"),
        F.coalesce(
            airport_name(departure_from_url(F.col("best_offer_url"))), F.lit(fv.OTHER_AIRPORTS)
        ).alias("_airport"),
        F.col("best_offer_url").alias("_url"),
    )
    better = F.col("_alt") < F.col("price")
    price, found = F.col("price"), F.col("_alt")
    return items.join(alt, keys, "left").select(
        *items.columns,
        F.when(better, found).alias("alt_price"),
        F.when(better, F.col("_airport")).alias("alt_airport"),
        F.when(better, savings(price, found)).alias("alt_savings"),
        F.when(better, savings_pct(price, found)).alias("alt_savings_percent"),
        F.when(better, F.col("_url")).alias("alt_url"),
    )

"""The item table of the dashboard and browsing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import delta_label, pct_change, whole
from faretide.functions.text import fill_default, first_filled, slugify
from faretide.functions.urls import airport_or_base
from faretide.operators.airports import alternatives_for_items
from faretide.operators.changes import (
    extreme_label_list,
    item_profile,
    latest_two,
    window_baseline,
)
from faretide.operators.filters import by_change_class, in_price_band, search_names
from faretide.operators.ranking import page, sort_by
from faretide.schema import KEY

CARRIED = ["dates", "duration", "departure_airport", "offer_url"]


def item_table(
    obs: DataFrame,
    alternatives: DataFrame | None = None,
    hours: int = 48,
    days: Sequence[int] = fv.EXTREME_DAYS,
) -> DataFrame:
    """One row per item: latest offer, recent and overall change, extremes, alternatives.

    One aggregate yields all but the second-to-last price, and both sides of
    the join are hashed by the item key already.
    """
    carried = [c for c in CARRIED if c in obs.columns]
    profile = item_profile(obs, [hours], days, carried).join(
        latest_two(obs).select(*KEY, "previous_price"), KEY
    )
    table = profile_table(profile, carried, hours, days)
    return table if alternatives is None else alternatives_for_items(table, alternatives)


def profile_table(profile: DataFrame, carried: Sequence[str], hours: int, days: Sequence[int]) -> DataFrame:
    """The item table of a profile that has the previous price beside."""
    price, base, first = F.col("price"), window_baseline(hours), F.col("first_price")
    moved = (base != 0) & (base != price)
    return profile.select(
        *KEY,
        "price",
        *carried,
        F.col("latest_at").alias("observed_at"),
        F.when(moved, price - base).alias("delta"),
        F.when(moved, pct_change(price, base, on_zero=None)).alias("delta_pct"),
        F.when(first != 0, price - first).alias("since_start"),
        pct_change(price, first, on_zero=None).alias("since_start_pct"),
        extreme_label_list(days).alias("labels"),
    )


def item_rows(table: DataFrame) -> DataFrame:
    """Display and sort values of the item table."""
    alternative = (
        [c for c in ("alt_price", "alt_airport", "alt_savings", "alt_savings_percent", "alt_url")]
        if "alt_price" in table.columns
        else []
    )
    return table.select(
        *KEY,
        slugify(F.col("hotel_name")).alias("slug"),
        F.concat(whole(F.col("price")), F.lit(" PLN")).alias("price_text"),
        F.col("price").alias("price_sort"),
        delta_label(F.col("delta"), F.col("delta_pct")).alias("delta_text"),
        F.coalesce("delta_pct", F.lit(0.0)).alias("delta_sort"),
        delta_label(F.col("since_start"), F.col("since_start_pct")).alias("since_text"),
        F.coalesce("since_start_pct", F.lit(0.0)).alias("since_sort"),
        fill_default(F.col("dates"), fv.DEFAULT_DATES).alias("dates"),
        fill_default(F.col("duration"), fv.DEFAULT_DURATION).alias("duration"),
        airport_or_base(F.col("departure_airport")).alias("airport"),
        first_filled(F.col("offer_url"), F.lit(fv.NO_VALUE)).alias("offer_link"),
        *alternative,
    )


def browse(
    table: DataFrame,
    search: str | None = None,
    band: str | None = None,
    change: str | None = None,
    sort: str = "price",
    desc: bool = False,
    number: int = 1,
    size: int = fv.PAGE_SIZE,
) -> DataFrame:
    """One page of the item table after search, price band and change filters."""
    if search:
        table = search_names(table, search)
    if band:
        table = in_price_band(table, band)
    if change:
        table = by_change_class(table, change)
    return page(sort_by(table, sort, desc), number, size)


def price_order(table: DataFrame) -> DataFrame:
    """All items, cheapest first."""
    return table.orderBy(F.asc("price"), F.asc("hotel_name"))

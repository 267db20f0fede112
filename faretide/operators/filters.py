"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import change_class
from faretide.functions.text import contains_term
from faretide.plans.ranges import range_join, range_totals
from faretide.plans.shape import is_small, pin
from faretide.schema import KEY


def valid_offers(df: DataFrame, text_col: str | None = None, min_text: int = fv.MIN_TEXT_LENGTH) -> DataFrame:
    """Offers with a positive, finite price and, if a text column is named, enough text."""
    kept = df.filter((F.col("price") > 0) & (F.col("price") < float("inf")))
    return long_enough(kept, text_col, min_text) if text_col else kept


def long_enough(df: DataFrame, text_col: str, min_text: int = fv.MIN_TEXT_LENGTH) -> DataFrame:
    return df.filter(F.length(F.trim(text_col)) >= min_text)


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["hotel_name", "price"])


def with_valid_time(df: DataFrame) -> DataFrame:
    return df.filter(F.col("observed_at").isNotNull())


def under_cap(df: DataFrame, cap: float = fv.PRICE_CAP) -> DataFrame:
    return df.filter(F.col("price") <= cap)


def by_threshold(df: DataFrame, pct: float | None = None, abs_change: float | None = None) -> DataFrame:
    """Changes at least as large as the given percentage and/or amount."""
    if pct is not None:
        df = df.filter(F.abs("price_change_pct") >= pct)
    if abs_change is not None:
        df = df.filter(F.abs("price_change") >= abs_change)
    return df


def drops(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price_change") < 0)


def increases(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price_change") > 0)


def min_observations(obs: DataFrame, n: int = 2) -> DataFrame:
    """Rows of items seen at least ``n`` times."""
    seen = obs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return obs.join(seen.select(*KEY), KEY, "left_semi")


def newest_per_dataset(obs: DataFrame) -> DataFrame:
    return obs.groupBy("dataset").agg(F.max("observed_at").alias("newest"))


def trailing_window(obs: DataFrame, hours: int) -> DataFrame:
    """Rows of the last ``hours`` hours before the newest row of their dataset, edge included.

    A table partitioned by ``obs_date`` is read from the earliest edge on only.
    """
    newest = pin(newest_per_dataset(obs))
    if "obs_date" in obs.columns:
        # One day of slack, as the partition day may follow another zone.
        earliest = F.min("newest") - F.make_dt_interval(days=F.lit(1), hours=F.lit(hours))
        obs = obs.filter(F.col("obs_date") >= newest.agg(F.to_date(earliest)).scalar())
    dated = obs.join(newest, "dataset")
    edge = F.col("newest") - F.make_dt_interval(hours=F.lit(hours))
    return dated.filter(F.col("observed_at") >= edge).drop("newest")


def search_names(df: DataFrame, term: str) -> DataFrame:
    return df.filter(contains_term(F.col("hotel_name"), term)) if term else df


def _in_band(low: float | None, high: float | None) -> Column:
    price = F.col("price")
    low_ok = F.lit(True) if low is None else price >= low
    return low_ok & (F.lit(True) if high is None else price <= high)


def in_price_band(df: DataFrame, band: str) -> DataFrame:
    bounds = {name: (low, high) for name, low, high in fv.PRICE_BANDS}
    return df.filter(_in_band(*bounds[band]))


def tag_price_bands(df: DataFrame) -> DataFrame:
    """One row per band a price falls in; a price on a shared edge is in two."""
    bands = F.array_compact(
        F.array(*[F.when(_in_band(low, high), F.lit(name)) for name, low, high in fv.PRICE_BANDS])
    )
    return df.withColumn("band", F.explode(bands))


def tag_bands(df: DataFrame, bands: DataFrame) -> DataFrame:
    """``tag_price_bands`` with bands as rows ``(band, low, high)``: any number, overlapping, with open (null) ends."""
    return range_join(df, bands.select("band", "low", "high"), "price").drop("low", "high")


def band_totals(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Offers, lowest and highest price of each band that holds any: ``tag_bands`` grouped by band, without its rows."""
    found = range_totals(df, bands.select("band", "low", "high"), "price")
    return found.toDF("band", "offers", "min_price", "max_price")


def by_change_class(df: DataFrame, change: str, change_col: str = "delta") -> DataFrame:
    return df.filter(change_class(F.col(change_col)) == change)


def _by_items(df: DataFrame, items: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join with the distinct items: broadcast if they are few, else a hash table of each task's share of them.

    The rows of ``df`` are never sorted, so a task's memory follows its items and not its rows.
    """
    found = items.select(*on).distinct()
    found = F.broadcast(found) if is_small(found) else found.hint("shuffle_hash")
    return df.join(found, list(on), how)


def keep_items(df: DataFrame, items: DataFrame, on: Sequence[str] = ("hotel_name",)) -> DataFrame:
    return _by_items(df, items, on, "left_semi")


def drop_items(df: DataFrame, items: DataFrame, on: Sequence[str] = ("hotel_name",)) -> DataFrame:
    return _by_items(df, items, on, "left_anti")

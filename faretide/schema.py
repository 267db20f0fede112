"""Canonical tables: observations, alerts, comparison results."""

from __future__ import annotations

from pyspark.sql import types as T

# An item is a hotel inside a dataset; a series is an item's rows in this order.
KEY = ["dataset", "hotel_name"]
ORDER = ["observed_at", "seq"]

OBSERVATION = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("hotel_name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("dates", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("departure_airport", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("offer_url", T.StringType()),
        T.StructField("from_airport", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("obs_date", T.DateType()),
        T.StructField("seq", T.LongType()),
    ]
)

_ALERT_FIELDS = [
    ("hotel_name", T.StringType()),
    ("old_price", T.DoubleType()),
    ("new_price", T.DoubleType()),
    ("price_change", T.DoubleType()),
    ("price_change_pct", T.DoubleType()),
    ("timestamp", T.StringType()),
    ("alert_type", T.StringType()),
    ("created_at", T.StringType()),
    ("threshold_percent", T.DoubleType()),
    ("unique_key", T.StringType()),
    ("note", T.StringType()),
]

# Names under which older histories keep the same facts.
_LEGACY_ALERT_FIELDS = [
    ("type", T.StringType()),
    ("hotel", T.StringType()),
    ("from", T.DoubleType()),
    ("to", T.DoubleType()),
    ("previous_price", T.DoubleType()),
    ("current_price", T.DoubleType()),
    ("time", T.StringType()),
    ("message", T.StringType()),
]

ALERT = T.StructType([T.StructField(n, t) for n, t in _ALERT_FIELDS])
RAW_ALERT = T.StructType([T.StructField(n, t) for n, t in _ALERT_FIELDS + _LEGACY_ALERT_FIELDS])

CHEAPER_ALTERNATIVE = T.StructType(
    [
        T.StructField("hotel_name", T.StringType()),
        T.StructField("base_price", T.DoubleType()),
        T.StructField("best_other_price", T.DoubleType()),
        T.StructField("savings", T.DoubleType()),
        T.StructField("savings_percent", T.DoubleType()),
        T.StructField("best_departure_airport", T.StringType()),
        T.StructField("best_offer_url", T.StringType()),
        T.StructField("best_dates", T.StringType()),
        T.StructField("best_duration", T.StringType()),
    ]
)

"""Alert tables: deduplication, missing items, counts, feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import arrow, signed_pct
from faretide.functions.text import first_filled
from faretide.functions.timestamps import utc_ts
from faretide.operators.filters import drops, increases
from faretide.operators.ranking import rank_per
from faretide.schema import KEY, ORDER


def new_alerts(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates whose key is not in the history, each key once: its first candidate by time, then by prices.

    Rows without a key are never taken for known ones. Keys are near unique,
    so both the anti join and the deduplication spread evenly.
    """
    known = history.select("unique_key").filter(F.col("unique_key").isNotNull()).distinct()
    fresh = candidates.join(known, "unique_key", "left_anti").select(*candidates.columns)
    order = [c for c in ("changed_at", "old_price", "new_price") if c in fresh.columns]
    order += [c for c in fresh.columns if c not in order]
    firsts = fresh.filter(F.col("unique_key").isNotNull()).groupBy("unique_key").agg(F.min(F.struct(*order)).alias("_first"))
    keyed = firsts.select("_first.*").select(*fresh.columns)
    return keyed.unionByName(fresh.filter(F.col("unique_key").isNull()))


def missing_items(
    history: DataFrame, current: DataFrame, price_limit: float | None = None, as_of: str | None = None
) -> DataFrame:
    """``missing`` alerts for items of the history that the current batch lacks."""
    note = fv.MISSING_NOTE + (fv.MISSING_NOTE_LIMIT % int(price_limit) if price_limit is not None else "")
    last = history.groupBy(*KEY).agg(
        F.max_by("price", F.struct(*ORDER)).alias("old_price"), F.max("observed_at").alias("last_seen")
    )
    seen = current.select("dataset", F.trim("hotel_name").alias("hotel_name")).distinct()
    return last.join(seen, KEY, "left_anti").select(
        *KEY,
        F.lit("missing").alias("alert_type"),
        "old_price",
        F.lit(None).cast("double").alias("new_price"),
        F.lit(as_of).cast("string").alias("timestamp"),
        F.lit(note).alias("note"),
        # The item stays missing until seen again, so one absence is one alert.
        F.concat_ws(
            "_", "hotel_name", F.date_format(F.col("last_seen").cast("timestamp_ntz"), fv.KEY_TIME_FORMAT), F.lit("missing")
        ).alias("unique_key"),
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("price_change") < 0).alias("drops"),
        F.count_if(F.col("price_change") > 0).alias("increases"),
    )


def top_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The n largest drops and the n largest rises of every dataset."""
    sides = drops(alerts).withColumn("side", F.lit("drop")).unionByName(
        increases(alerts).withColumn("side", F.lit("increase"))
    )
    order = [F.desc(F.abs("price_change")), F.asc("hotel_name"), F.asc("unique_key")]
    return rank_per(sides, ["dataset", "side"], order, n)


def feed_time(*cols: Column) -> Column:
    """First filled time text as an instant; text without a zone is UTC."""
    return utc_ts(first_filled(*cols))


def alert_feed(alerts: DataFrame) -> DataFrame:
    """Alerts newest first; rows without a readable time come last."""
    columns = alerts.columns
    times = [F.col(c) for c in ("created_at", "timestamp", "time") if c in columns]
    ties = [F.asc_nulls_last(c) for c in ("unique_key", "hotel_name") if c in columns]
    return alerts.withColumn("feed_time", feed_time(*times)).orderBy(
        F.desc_nulls_last("feed_time"), *ties
    )


def feed_rows(alerts: DataFrame) -> DataFrame:
    """Display columns of the alert feed, missing items included."""
    gone = F.col("new_price").isNull() | F.coalesce(F.col("alert_type") == "missing", F.lit(False))
    change, pct = F.coalesce("price_change", F.lit(0.0)), F.coalesce("price_change_pct", F.lit(0.0))
    old = F.coalesce(F.col("old_price").cast("string"), F.lit(fv.NO_VALUE))
    mark = F.when(gone, F.lit("missing")).when(change > 0, F.lit("increase")).when(
        change < 0, F.lit("decrease")
    ).otherwise(F.lit(""))
    text = F.when(
        gone, F.concat(F.lit(fv.NO_VALUE + " "), first_filled(F.col("note"), F.lit(fv.MISSING_FEED_TEXT)))
    ).otherwise(F.concat(arrow(change), F.lit(" "), signed_pct(pct)))
    prices = F.when(gone, F.concat(old, F.lit(" → " + fv.NO_VALUE))).otherwise(
        F.concat(old, F.lit(" → "), F.col("new_price").cast("string"), F.lit(" PLN"))
    )
    return alert_feed(alerts).select(
        first_filled(F.col("hotel_name"), F.lit(fv.UNKNOWN_HOTEL)).alias("hotel_name"),
        mark.alias("direction"),
        text.alias("change_text"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        prices.alias("price_text"),
        "feed_time",
    )

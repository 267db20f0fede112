"""Price changes of items over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import alert_key, direction, pct_change
from faretide.operators.filters import by_threshold, newest_per_dataset
from faretide.operators.ranking import rank_per
from faretide.plans.runs import run_cells, run_prices, tag_runs
from faretide.plans.shape import SERIES_ROWS, attach, lag_in_series, pin
from faretide.schema import KEY, ORDER


def as_alerts(
    changes: DataFrame, threshold: float, created_at: str | None = None, signed: bool = True
) -> DataFrame:
    """Alert columns for (old_price, new_price, changed_at) rows at or over the threshold."""
    new, old = F.col("new_price"), F.col("old_price")
    scored = changes.withColumn("price_change", new - old).withColumn(
        "price_change_pct", pct_change(new, old)
    )
    return by_threshold(scored, pct=threshold).select(
        *KEY,
        "old_price",
        "new_price",
        "price_change",
        "price_change_pct",
        "changed_at",
        direction(F.col("price_change")).alias("alert_type"),
        F.lit(created_at).cast("string").alias("created_at"),
        F.lit(float(threshold)).alias("threshold_percent"),
        alert_key(F.col("hotel_name"), F.col("changed_at"), F.col("price_change_pct"), signed).alias(
            "unique_key"
        ),
    )


def consecutive_pairs(obs: DataFrame, max_rows: int = SERIES_ROWS) -> DataFrame:
    """Every observation with the preceding price of the same item."""
    series = obs.select(*KEY, "price", *ORDER)
    paired = lag_in_series(series, ["price", "seq"], KEY, ORDER, max_rows=max_rows)
    return paired.filter(F.col("prev_seq").isNotNull()).select(
        *KEY,
        F.col("prev_price").alias("old_price"),
        F.col("price").alias("new_price"),
        F.col("observed_at").alias("changed_at"),
    )


def consecutive_changes(
    obs: DataFrame,
    threshold: float = fv.ALERT_THRESHOLD_PCT,
    created_at: str | None = None,
    max_rows: int = SERIES_ROWS,
) -> DataFrame:
    """Alerts between consecutive observations of an item."""
    return as_alerts(consecutive_pairs(obs, max_rows), threshold, created_at, signed=False)


def run_series(tagged: DataFrame) -> DataFrame:
    """Price of every item in every run, with its price in the run right before, if it was there.

    One row per item and run is left after the first aggregate, so the window
    sees at most as many rows per item as there are runs.
    """
    series = Window.partitionBy(*KEY).orderBy("run_id")
    paired = run_prices(tagged).select(
        "*",
        F.lag("price").over(series).alias("_prev_price"),
        F.lag("run_id").over(series).alias("_prev_run"),
    )
    follows = F.coalesce(F.col("_prev_run") == F.col("run_id") - 1, F.lit(False))
    return paired.select(
        *KEY,
        "run_id",
        follows.alias("follows"),
        F.when(follows, F.col("_prev_price")).alias("old_price"),
        F.col("price").alias("new_price"),
        F.col("run_start").alias("changed_at"),
    )


def run_pairs(tagged: DataFrame) -> DataFrame:
    """Items present in a run and in the one right before it."""
    return run_series(tagged).filter("follows").drop("follows")


def run_changes(
    tagged: DataFrame, threshold: float = fv.ALERT_THRESHOLD_PCT, created_at: str | None = None
) -> DataFrame:
    """Alerts between a run and the one before it."""
    return as_alerts(run_pairs(tagged), threshold, created_at, signed=True)


def latest_two(obs: DataFrame) -> DataFrame:
    """Last price and the one before it, per item; the rank filter runs before the shuffle."""
    newest = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ORDER])
    ranked = (
        obs.select(*KEY, "price", *ORDER)
        .withColumn("_pos", F.row_number().over(newest))
        .filter(F.col("_pos") <= 2)
    )
    return ranked.groupBy(*KEY).agg(
        F.max(F.when(F.col("_pos") == 1, F.col("price"))).alias("last_price"),
        F.max(F.when(F.col("_pos") == 2, F.col("price"))).alias("previous_price"),
    )


def item_profile(
    obs: DataFrame,
    hours: Sequence[int] = (),
    days: Sequence[int] = (),
    carried: Sequence[str] = (),
) -> DataFrame:
    """Everything known of an item in one aggregate, one row per item.

    Latest row, first price, and for each trailing window its row count and
    first price (``hours``) or its lowest and highest price (``days``).
    Windows end at the newest row of the dataset and include their edge.
    """
    order = F.struct(*ORDER)
    rows = obs.select(*KEY, "price", *ORDER, *carried)
    dated = attach(rows, newest_per_dataset(obs), ["dataset"])
    measures = [
        F.max_by(F.struct("price", *carried), order).alias("_last"),
        F.min_by("price", order).alias("first_price"),
        F.max("observed_at").alias("latest_at"),
    ]
    for h in hours:
        inside = F.col("observed_at") >= F.col("newest") - F.make_dt_interval(hours=F.lit(h))
        measures.append(F.count_if(inside).alias(f"_n_{h}"))
        measures.append(F.min_by("price", F.when(inside, order)).alias(f"_base_{h}"))
    for d in days:
        inside = F.col("observed_at") >= F.col("newest") - F.make_dt_interval(days=F.lit(d))
        measures.append(F.min(F.when(inside, F.col("price"))).alias(f"_min_{d}"))
        measures.append(F.max(F.when(inside, F.col("price"))).alias(f"_max_{d}"))
    profile = dated.groupBy(*KEY).agg(*measures)
    return profile.select("*", "_last.*").drop("_last")


def window_baseline(hours: int) -> Column:
    """First price inside the window if it holds two or more rows, else the item's previous price."""
    return F.when(F.col(f"_n_{hours}") >= 2, F.col(f"_base_{hours}")).otherwise(F.col("previous_price"))


def extreme_label_list(days: Sequence[int]) -> Column:
    """Labels of the windows in which the latest price is the lowest or the highest."""
    labels = []
    for d in days:
        labels.append(F.when(F.col("price") <= F.col(f"_min_{d}"), F.lit(fv.NEW_MINIMUM % d)))
        labels.append(F.when(F.col("price") >= F.col(f"_max_{d}"), F.lit(fv.NEW_MAXIMUM % d)))
    return F.array_compact(F.array(*labels))


def window_changes(obs: DataFrame, hours: Sequence[int] = fv.MOVER_HOURS) -> DataFrame:
    """Change of every item over each trailing window, one row per (item, window).

    Without a baseline, with a zero baseline or without any change the item
    has no row. All windows share one aggregate.
    """
    return profile_changes(item_profile(obs, hours).join(latest_two(obs), KEY), hours)


def profile_changes(profile: DataFrame, hours: Sequence[int]) -> DataFrame:
    """``window_changes`` of a profile that has the previous price beside."""
    windows = F.array(
        *[F.struct(F.lit(h).alias("window_hours"), window_baseline(h).alias("old_price")) for h in hours]
    )
    rows = profile.select(*KEY, "latest_at", F.col("price").alias("new_price"), F.inline(windows))
    new, old = F.col("new_price"), F.col("old_price")
    return rows.filter((old != 0) & (new != old)).select(
        *KEY,
        "window_hours",
        "old_price",
        "new_price",
        (new - old).alias("price_change"),
        pct_change(new, old, on_zero=None).alias("price_change_pct"),
        "latest_at",
    )


def movers(obs: DataFrame, hours: Sequence[int] = fv.MOVER_HOURS, n: int = 5) -> DataFrame:
    """The n largest falls and the n largest rises of every window."""
    changed = window_changes(obs, hours).withColumn(
        "side", F.when(F.col("price_change") < 0, F.lit("decrease")).otherwise(F.lit("increase"))
    )
    largest = [F.desc(F.abs("price_change")), F.asc("hotel_name")]
    return rank_per(changed, ["dataset", "window_hours", "side"], largest, n)


def extreme_labels(obs: DataFrame, days: Sequence[int] = fv.EXTREME_DAYS) -> DataFrame:
    """Labels of items whose latest price is the lowest or highest of a trailing window."""
    return profile_labels(item_profile(obs, days=days), days)


def profile_labels(profile: DataFrame, days: Sequence[int]) -> DataFrame:
    return profile.select(*KEY, "price", extreme_label_list(days).alias("labels"))


def snapshot_changes(
    obs: DataFrame,
    threshold: float = fv.SNAPSHOT_THRESHOLD,
    mode: str = "max_ts",
    gap: str = fv.RUN_GAP,
) -> DataFrame:
    """Items of the newest snapshot against their last earlier price.

    ``max_ts``: the snapshot is the rows at the newest time. ``last_run``: it
    is the newest run.
    """
    if mode == "max_ts":
        dated = attach(obs, newest_per_dataset(obs), ["dataset"])
        current = F.col("observed_at") == F.col("newest")
    else:
        cells = pin(run_cells(obs, gap))
        last = cells.groupBy("dataset").agg(F.max("run_id").alias("newest"))
        dated = attach(tag_runs(obs, gap, cells), last, ["dataset"])
        current = F.col("run_id") == F.col("newest")
    order = F.struct(*ORDER)
    # The first row of the snapshot speaks for the item, as a snapshot lists it once.
    sides = dated.groupBy(*KEY).agg(
        F.max_by("price", F.when(~current, order)).alias("old_price"),
        F.min_by("price", F.when(current, order)).alias("new_price"),
        F.count_if(current).alias("_now"),
        F.count_if(~current).alias("_before"),
    )
    new, old = F.col("new_price"), F.col("old_price")
    both = sides.filter((F.col("_now") > 0) & (F.col("_before") > 0)).select(
        *KEY,
        "old_price",
        "new_price",
        (new - old).alias("price_change"),
        pct_change(new, old, on_zero=None).alias("price_change_pct"),
    )
    return by_threshold(both, abs_change=threshold)

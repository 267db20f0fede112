"""Stored daily panes of items, and the newest facts of every item from them.

A pane is what is known of one item on one day: number of offers, first row, the last two rows, lowest and highest
price. A trailing window is made of the panes of whole days and of the rows of the day its edge falls in, so
the facts of the last days cost one row per item and day of history and the rows of one day per window. Late rows
replace the panes of their days alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.operators.changes import latest_two, profile_changes, profile_labels
from faretide.operators.tables import CARRIED, profile_table
from faretide.plans.shape import attach, pin
from faretide.schema import KEY, ORDER
from faretide.sources.days import near_days, store_days

PANE_KEY = [*KEY, "day"]


def _row(*columns: str) -> Column:
    return F.struct(*ORDER, *columns)


def day_panes(obs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per item and day (of the session's zone): ``offers, first, last, previous, low, high``.

    ``first``, ``last`` and ``previous`` (the row before the last, if any) hold time, ``seq`` and price, ``last`` the
    ``carried`` columns too. Rows without a time are left out.
    """
    rows = obs.filter("observed_at is not null").select(
        *KEY, F.to_date("observed_at").alias("day"), *ORDER, "price", *carried
    )
    sums = rows.groupBy(*PANE_KEY).agg(
        F.count(F.lit(1)).alias("offers"),
        F.min_by(_row("price"), F.struct(*ORDER)).alias("first"),
        F.max_by(_row("price", *carried), F.struct(*ORDER)).alias("last"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )
    # Ranks are limited before the shuffle: at most two rows per task and pane move.
    newest = Window.partitionBy(*PANE_KEY).orderBy(*[F.desc(c) for c in ORDER])
    second = rows.select(*PANE_KEY, *ORDER, "price").withColumn("_pos", F.row_number().over(newest))
    second = second.filter(F.col("_pos") <= 2).groupBy(*PANE_KEY).agg(
        F.max(F.when(F.col("_pos") == 2, _row("price"))).alias("previous")
    )
    sums, second = sums.alias("a"), second.alias("b")
    same = F.lit(True)
    for c in PANE_KEY:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return sums.join(second, same).select(
        *[f"a.{c}" for c in PANE_KEY], "offers", "first", "last", "previous", "low", "high"
    )


def store_panes(
    spark: SparkSession,
    table_path: str,
    panes_path: str,
    fresh: DataFrame | None = None,
    carried: Sequence[str] = CARRIED,
) -> None:
    """Write the panes of the observation table, or only those of the (dataset, day) pairs that ``fresh`` rows touch."""
    store_days(spark, table_path, panes_path, lambda rows: day_panes(rows, carried), fresh)


def pane_profile(
    panes: DataFrame,
    obs: DataFrame,
    hours: Sequence[int] = (),
    days: Sequence[int] = (),
    carried: Sequence[str] = (),
) -> DataFrame:
    """``changes.item_profile`` of all rows, with ``previous_price``, from panes and the rows of the edge days.

    ``obs`` is the table behind the panes; of it only the days in which a window begins are read.
    """
    spans = {f"h{h}": F.make_dt_interval(hours=F.lit(h)) for h in hours}
    spans |= {f"d{d}": F.make_dt_interval(days=F.lit(d)) for d in days}
    newest = panes.groupBy("dataset").agg(F.max("last.observed_at").alias("newest"))
    # One row per dataset.
    edges = pin(newest.select("dataset", *[(F.col("newest") - span).alias(f"_edge_{w}") for w, span in spans.items()]))
    whole = attach(panes, edges, ["dataset"]).withColumn("_of", F.lit(None).cast("string"))
    if spans:
        listed = F.array(*[F.struct(F.lit(w).alias("_of"), F.col(f"_edge_{w}").alias("_edge")) for w in spans])
        begun = edges.select("dataset", F.inline(listed)).withColumn("day", F.to_date("_edge"))
        rows = near_days(obs, begun).select(*KEY, "price", *ORDER, F.to_date("observed_at").alias("day"))
        parts = attach(rows, begun, ["dataset", "day"], "inner").filter(F.col("observed_at") >= F.col("_edge"))
        parts = parts.groupBy(*KEY, "_of").agg(
            F.count(F.lit(1)).alias("offers"),
            F.min_by(_row("price"), F.struct(*ORDER)).alias("first"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
        )
        whole = whole.unionByName(parts, allowMissingColumns=True)
    own = F.col("_of").isNull()
    measures = [
        F.max(F.when(own, F.col("last"))).alias("_last"),
        F.min(F.when(own, F.col("first"))).alias("_first"),
    ]
    for h in hours:
        inside = F.when(own, F.col("day") > F.to_date(f"_edge_h{h}")).otherwise(F.col("_of") == f"h{h}")
        measures.append(F.coalesce(F.sum(F.when(inside, F.col("offers"))), F.lit(0)).alias(f"_n_{h}"))
        measures.append(F.min(F.when(inside, F.col("first"))).alias(f"_base_{h}"))
    for d in days:
        inside = F.when(own, F.col("day") > F.to_date(f"_edge_d{d}")).otherwise(F.col("_of") == f"d{d}")
        measures.append(F.min(F.when(inside, F.col("low"))).alias(f"_min_{d}"))
        measures.append(F.max(F.when(inside, F.col("high"))).alias(f"_max_{d}"))
    profile = whole.groupBy(*KEY).agg(*measures)
    named = [F.col(f"_base_{h}.price").alias(f"_base_{h}") for h in hours] + [f"_n_{h}" for h in hours]
    named += [f"_{e}_{d}" for d in days for e in ("min", "max")]
    # The two newest rows of an item are among the two newest of its panes.
    last = F.struct(*[F.col("last")[c].alias(c) for c in (*ORDER, "price")])
    two = latest_two(panes.select(*KEY, F.inline(F.array_compact(F.array(last, F.col("previous"))))))
    return profile.join(two.select(*KEY, "previous_price"), KEY).select(
        *KEY,
        F.col("_last.price").alias("price"),
        *[F.col("_last")[c].alias(c) for c in carried],
        F.col("_first.price").alias("first_price"),
        F.col("_last.observed_at").alias("latest_at"),
        *named,
        "previous_price",
    )


def pane_window_changes(panes: DataFrame, obs: DataFrame, hours: Sequence[int] = fv.MOVER_HOURS) -> DataFrame:
    """``changes.window_changes`` from panes and edge days."""
    return profile_changes(pane_profile(panes, obs, hours), hours)


def pane_extreme_labels(panes: DataFrame, obs: DataFrame, days: Sequence[int] = fv.EXTREME_DAYS) -> DataFrame:
    """``changes.extreme_labels`` from panes and edge days."""
    return profile_labels(pane_profile(panes, obs, days=days), days)


def pane_item_table(
    panes: DataFrame, obs: DataFrame, hours: int = 48, days: Sequence[int] = fv.EXTREME_DAYS
) -> DataFrame:
    """``tables.item_table``, without alternatives, from panes and edge days."""
    carried = [c for c in CARRIED if c in panes.select("last.*").columns]
    return profile_table(pane_profile(panes, obs, [hours], days, carried), carried, hours, days)

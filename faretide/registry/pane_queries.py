"""Results from stored daily panes and counts, some of which late rows replaced."""

from pyspark.sql import functions as F

from faretide.adapters import events_obs
from faretide.operators import day_state, panes
from faretide.registry import QUERIES, change_queries, query, stats_queries  # noqa: F401
from faretide.registry import sql as q
from faretide.schema import OBSERVATION
from faretide.session import scratch_path
from faretide.sources.days import read_days, store_days
from faretide.sources.observations import append_observations, read_table


def _stored(spark, sf_dir):
    """The events as a table with panes; a ninth of the rows comes late, after the panes are first stored."""
    root = scratch_path(spark, "panes")
    obs = events_obs(spark, sf_dir).select(*OBSERVATION.fieldNames())
    late = obs.filter("seq % 9 = 0")
    append_observations(obs.filter("seq % 9 <> 0"), f"{root}/table")
    panes.store_panes(spark, f"{root}/table", f"{root}/panes")
    append_observations(late, f"{root}/table")
    panes.store_panes(spark, f"{root}/table", f"{root}/panes", late)
    return read_days(spark, f"{root}/panes"), read_table(spark, f"{root}/table")


@query("w04_from_panes", QUERIES["w04_window_changes"].sql)
def w04b(spark, sf_dir):
    return panes.pane_window_changes(*_stored(spark, sf_dir)).drop("dataset")


@query("w08_from_panes", QUERIES["w08_extreme_labels"].sql)
def w08b(spark, sf_dir):
    labelled = panes.pane_extreme_labels(*_stored(spark, sf_dir))
    return labelled.select("hotel_name", "price", F.array_join("labels", ";").alias("labels"))


@query("j12_from_panes", QUERIES["j12_item_table"].sql)
def j12b(spark, sf_dir):
    table = panes.pane_item_table(*_stored(spark, sf_dir)).drop("dataset")
    return table.withColumn("labels", F.array_join("labels", ";"))


def _days(spark, obs, *builds):
    """Daily state of a table of which a ninth came late."""
    root = scratch_path(spark, "days")
    late = obs.filter("seq % 9 = 0")
    append_observations(obs.filter("seq % 9 <> 0"), f"{root}/table")
    for fresh in (None, late):
        if fresh is not None:
            append_observations(fresh, f"{root}/table")
        for build in builds:
            store_days(spark, f"{root}/table", f"{root}/{build.__name__}", build, fresh)
    return [read_days(spark, f"{root}/{build.__name__}") for build in builds]


def _two_sets(spark, sf_dir):
    """The events as two datasets, errors and the rest."""
    kind = F.when(F.col("departure_airport") == "error", F.lit("errors")).otherwise(F.lit("events"))
    return events_obs(spark, sf_dir).withColumn("dataset", kind).select(*OBSERVATION.fieldNames())


_TWO_SETS = f"WITH {q.EVENTS}, u AS (SELECT * REPLACE (CASE WHEN departure_airport = 'error' THEN 'errors' ELSE 'events' END AS dataset) FROM obs)"


@query(
    "a02_from_counts",
    _TWO_SETS + f""" SELECT dataset, count(*) AS offers, count(DISTINCT hotel_name) AS hotels, {q.MEAN} AS mean_price,
        min(price) AS min_price, max(price) AS max_price, round(median(price), 4) AS median_price,
        round(stddev_samp(price), 4) AS std_price, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM u GROUP BY 1""",
)
def a02c(spark, sf_dir):
    out = day_state.describe_counts(*_days(spark, _two_sets(spark, sf_dir), day_state.price_counts, day_state.item_days))
    return out.withColumn("median_price", F.round("median_price", 4)).withColumn("std_price", F.round("std_price", 4))


@query("a05_from_counts", QUERIES["a05_daily_distribution"].sql)
def a05c(spark, sf_dir):
    (counts,) = _days(spark, events_obs(spark, sf_dir).select(*OBSERVATION.fieldNames()), day_state.price_counts)
    boxes = day_state.distribution_of_counts(counts)
    return boxes.select("day", *[F.round(c, 4).alias(c) for c in day_state.BOX], "whisker_low", "whisker_high", "outliers", "offers")


@query(
    "a21_item_rollup",
    _TWO_SETS + f""" SELECT dataset, obs_date::VARCHAR AS day, count(price) AS offers, {q.MEAN} AS mean_price, min(price) AS min_price, max(price) AS max_price,
          count(DISTINCT hotel_name) AS exact_items, true AS near FROM u GROUP BY ROLLUP (dataset, obs_date)""",
)
def a21b(spark, sf_dir):
    """Distinct items of every level; the merged sketches are within 5 % (six standard errors) of the exact number."""
    totals, items = _days(spark, _two_sets(spark, sf_dir), day_state.day_totals, day_state.item_days)
    sketched = day_state.item_rollup(totals).alias("s")
    exact = day_state.exact_item_rollup(items).withColumnRenamed("items", "exact_items").alias("e")
    same = F.col("s.dataset").eqNullSafe(F.col("e.dataset")) & F.col("s.day").eqNullSafe(F.col("e.day"))
    near = F.abs(F.col("items") - F.col("exact_items")) <= 0.05 * F.col("exact_items")
    return sketched.join(exact, same).select(
        "s.dataset", "s.day", "offers", "mean_price", "min_price", "max_price", "exact_items", near.alias("near")
    )

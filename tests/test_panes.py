"""Newest facts from daily panes against those from all rows."""

import datetime as dt
import random

import pytest
from conftest import as_set, at
from pyspark.sql import functions as F

from faretide.operators import changes, panes, tables
from faretide.sources import days
from faretide.sources.observations import append_observations, read_table


def rows(seed, n=300):
    """Items of three datasets over forty days; ties in time, rows on the edges of windows, zero and missing prices."""
    rng = random.Random(seed)
    newest = at("2025-03-10T12:00:00")
    made = []
    for _ in range(n):
        back = rng.choice([dt.timedelta(hours=h) for h in (0, 24, 48, 168)] + [dt.timedelta(days=30)])
        if rng.random() < 0.7:
            back = dt.timedelta(minutes=rng.randrange(40 * 1440))
        made.append({
            "dataset": rng.choice("abc"), "hotel_name": rng.choice("pqrst"), "observed_at": newest - back,
            "price": rng.choice([None, 0.0, 10.0, 20.0, 30.0]), "dates": rng.choice(["x", "y"]),
        })
    made.append({"dataset": "lone", "hotel_name": "z", "observed_at": at("2024-01-01T00:00:00"), "price": 1.0})
    return made


PROFILE = ["dataset", "hotel_name", "price", "first_price", "latest_at", "dates", "_n_24", "_n_168", "_base_24", "_base_168",
           "_min_7", "_max_7", "_min_30", "_max_30", "previous_price"]


def same(obs, stored, table):
    whole = changes.item_profile(obs, [24, 168], [7, 30], ["dates"]).join(changes.latest_two(obs), ["dataset", "hotel_name"])
    got = panes.pane_profile(stored, table, [24, 168], [7, 30], ["dates"])
    assert as_set(got, *PROFILE) == as_set(whole, *PROFILE)
    for mine, plain in (
        (panes.pane_window_changes(stored, table), changes.window_changes(obs)),
        (panes.pane_extreme_labels(stored, table), changes.extreme_labels(obs)),
        (panes.pane_item_table(stored, table), tables.item_table(obs.drop("url", "image_url"))),
    ):
        assert as_set(mine, *sorted(plain.columns)) == as_set(plain, *sorted(plain.columns))


@pytest.mark.parametrize("seed", [1])
def test_equal_to_all_rows_before_and_after_late_rows(spark, make_obs, tmp_path, seed):
    table, stored = str(tmp_path / "table"), str(tmp_path / "panes")
    obs = make_obs(rows(seed)).withColumn("obs_date", F.to_date("observed_at")).withColumn("from_airport", F.lit(None).cast("string"))
    obs = obs.withColumn("rating", F.lit("")).withColumn("scraped_at", F.lit("")).cache()
    early, late = obs.filter("seq % 5 <> 0"), obs.filter("seq % 5 = 0")
    append_observations(early, table)
    panes.store_panes(spark, table, stored)
    same(early, days.read_days(spark, stored), read_table(spark, table))
    append_observations(late, table)
    panes.store_panes(spark, table, stored, late)
    same(obs, days.read_days(spark, stored), read_table(spark, table))


def test_rows_are_read_for_edge_days_only(spark, make_obs, tmp_path):
    table, stored = str(tmp_path / "table"), str(tmp_path / "panes")
    obs = make_obs(rows(3)).withColumn("obs_date", F.to_date("observed_at"))
    append_observations(obs, table)
    panes.store_panes(spark, table, stored, carried=())
    files = days.near_days(read_table(spark, table).filter("dataset = 'a'"), spark.sql("SELECT date'2025-03-09' AS day"))
    seen = {r[0].day for r in files.select("obs_date").distinct().collect()}
    assert seen <= {8, 9, 10}
    plan = panes.pane_window_changes(days.read_days(spark, stored), read_table(spark, table), [24])._jdf.queryExecution().toString()
    assert "obs_date" in plan and "PartitionFilters: [isnotnull(obs_date" in plan or "obs_date#" in plan and " IN (" in plan
    named, days.NAMED_DAYS = days.NAMED_DAYS, 1
    try:
        many = panes.pane_window_changes(days.read_days(spark, stored), read_table(spark, table))
        assert as_set(many, "hotel_name", "window_hours", "old_price") == as_set(
            changes.window_changes(obs), "hotel_name", "window_hours", "old_price")
    finally:
        days.NAMED_DAYS = named


def test_no_rows(spark, make_obs):
    none = make_obs([])
    assert panes.pane_window_changes(panes.day_panes(none), none).count() == 0
    assert panes.day_panes(make_obs([{"observed_at": None}])).count() == 0

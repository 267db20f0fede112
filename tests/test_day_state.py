"""Distributions and item counts from daily state against those from all rows."""

import datetime as dt
import random

from conftest import as_set, at
from pyspark.sql import functions as F

from faretide.operators import day_state, stats
from faretide.plans import shape

BOX = ["dataset", "day", "q1", "median_price", "q3", "whisker_low", "whisker_high", "outliers", "offers"]


def observations(make_obs):
    rng = random.Random(11)
    prices = [None, 0.0, 10.0, 10.0, 12.25, 99.5, 1e6, float("nan"), float("inf")]
    rows = [
        {"dataset": rng.choice("ab"), "hotel_name": f"h{rng.randrange(40)}", "price": rng.choice(prices),
         "observed_at": at("2025-01-01T00:00:00") + dt.timedelta(minutes=rng.randrange(4 * 1440))}
        for _ in range(400)
    ]
    rows.append({"dataset": "blank", "hotel_name": "h", "price": None})
    rows.append({"dataset": "one", "hotel_name": "h", "price": 5.0})
    return make_obs(rows).cache()


def near(rows):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]


def test_distributions_equal_those_of_all_rows(make_obs, monkeypatch):
    obs = observations(make_obs)
    counts, items = day_state.price_counts(obs), day_state.item_days(obs)
    for limit in (shape.SERIES_ROWS, 5):  # also with keys numbered in range blocks
        monkeypatch.setattr(day_state, "running_total", lambda *a, limit=limit: shape.running_total(*a, max_rows=limit))
        plain = stats.describe_prices(obs)
        columns = sorted(plain.columns)
        assert near(as_set(day_state.describe_counts(counts, items), *columns)) == near(as_set(plain, *columns))
        boxes = day_state.distribution_of_counts(counts)
        assert near(as_set(boxes, *BOX)) == near(as_set(stats.daily_distribution(obs), *BOX))
    some = counts.filter("day <= date'2025-01-02'")
    part = stats.describe_prices(obs.filter("observed_at < '2025-01-03'"))
    assert near(as_set(day_state.describe_counts(some, items.filter("day <= date'2025-01-02'")), *columns)) == near(as_set(part, *columns))


def test_items_of_every_level(spark, make_obs):
    obs = observations(make_obs)
    rolled = day_state.item_rollup(day_state.day_totals(obs))
    plain = stats.kpi_rollup(obs)
    assert near(as_set(rolled, *plain.columns)) == near(as_set(plain, *plain.columns))
    exact = as_set(day_state.exact_item_rollup(day_state.item_days(obs)), "dataset", "day", "items")
    # So few items are counted exactly by a sketch.
    assert as_set(rolled, "dataset", "day", "items") == exact
    many = spark.range(60_000).select(
        F.lit("d").alias("dataset"), F.concat(F.lit("h"), (F.col("id") % 20_000).cast("string")).alias("hotel_name"),
        F.lit(1.0).alias("price"), F.timestamp_seconds((F.col("id") % 7) * 86_400).alias("observed_at"),
    )
    top = day_state.item_rollup(day_state.day_totals(many)).filter("dataset is null").first()
    assert top["offers"] == 60_000 and abs(top["items"] - 20_000) <= 0.05 * 20_000


def test_no_rows(make_obs):
    none = make_obs([])
    assert day_state.describe_counts(day_state.price_counts(none), day_state.item_days(none)).count() == 0
    assert day_state.distribution_of_counts(day_state.price_counts(none)).count() == 0

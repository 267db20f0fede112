"""The paths taken for hot keys and large sides give the same rows as the ordinary ones."""

import random

import pytest
from conftest import as_set, at
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faretide.operators import changes, reports, stats
from faretide.plans import quantiles, shape
from faretide.sources.series import price_series


@pytest.fixture(scope="module")
def skewed(make_obs):
    """One hotel with most rows, many equal times, and some small hotels."""
    rng = random.Random(7)
    rows = [
        {
            "hotel_name": "hot" if rng.random() < 0.8 else f"h{rng.randrange(5)}",
            "price": float(rng.randrange(1, 60)),
            "observed_at": at(f"2025-01-{rng.choice([1, 1, 1, 2, 3]):02d}T00:00:00"),
            "seq": i,
        }
        for i in range(600)
    ]
    return make_obs(rows).repartition(7)


def test_lag_over_blocks(skewed):
    columns = ["hotel_name", "old_price", "new_price", "changed_at"]
    plain = as_set(changes.consecutive_pairs(skewed), *columns)
    assert len(plain) == 600 - 6
    assert as_set(changes.consecutive_pairs(skewed, max_rows=50), *columns) == plain


def test_only_heavy_keys_are_split(skewed):
    light, heavy = shape.split_heavy(skewed, ["dataset", "hotel_name"], ["observed_at", "seq"], 200)
    assert {r["hotel_name"] for r in heavy.select("hotel_name").distinct().collect()} == {"hot"}
    assert light.count() + heavy.count() == 600
    assert heavy.groupBy("_block").count().agg(F.max("count")).first()[0] < 300
    assert shape.split_heavy(skewed, ["hotel_name"], ["seq"], 1000)[1] is None


def test_running_total_over_blocks(skewed):
    keys, order = ["dataset"], ["price", "seq"]
    plain = shape.running_total(skewed, F.lit(1).cast("bigint"), keys, order, "n")
    split = shape.running_total(skewed, F.lit(1).cast("bigint"), keys, order, "n", max_rows=40)
    assert as_set(plain, "seq", "n") == as_set(split, "seq", "n")
    assert sorted(r["n"] for r in split.collect()) == list(range(1, 601))


def test_report_positions_over_blocks(skewed):
    alerts = changes.consecutive_changes(skewed)
    columns = ["section", "position", "line"]
    assert as_set(reports.alert_report_rows(alerts, max_rows=30), *columns) == as_set(
        reports.alert_report_rows(alerts), *columns
    )


def test_series_parts_join_up(skewed):
    whole = {r["hotel_name"]: (r["x"], r["y"]) for r in price_series(skewed).collect()}
    parts = price_series(skewed, max_points=60).orderBy("hotel_name", "part").collect()
    joined = {}
    for r in parts:
        x, y = joined.setdefault(r["hotel_name"], ([], []))
        x += r["x"]
        y += r["y"]
    assert joined == whole
    assert len(parts) > len(whole) and max(len(r["y"]) for r in parts) < 120


@pytest.mark.parametrize("max_rows, buckets", [(1_000_000, 8), (100, 8), (1, 4096), (1, 1), (1, 2)])
def test_quantiles_are_exact(skewed, max_rows, buckets):
    levels = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    got = quantiles.exact_quantiles(skewed, ["hotel_name"], "price", levels, max_rows, buckets)
    want = skewed.groupBy("hotel_name").agg(
        *[F.percentile("price", p).alias(n) for n, p in levels.items()]
    )
    rounded = [F.round(c, 9).alias(c) for c in levels]
    assert as_set(got.select("hotel_name", *rounded), "hotel_name", *levels) == as_set(
        want.select("hotel_name", *rounded), "hotel_name", *levels
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_beyond_each_limit(spark, skewed, how):
    side = spark.createDataFrame([(f"h{i}", i) for i in range(3)], "hotel_name string, v int")
    sizes = [dict(), dict(local_rows=1), dict(local_rows=1, max_rows=1)]
    results = [shape.attach(skewed.select("hotel_name", "seq"), side, ["hotel_name"], how, **s) for s in sizes]
    rows = [as_set(r, *r.columns) for r in results]
    assert rows[0] == rows[1] == rows[2] and rows[0]


def test_large_side_is_not_broadcast(spark, skewed):
    side = spark.range(1000).select(F.concat(F.lit("h"), F.col("id")).alias("hotel_name"))
    pinned = shape.pin(side, local_rows=10, max_rows=100)
    assert "broadcast" not in pinned._jdf.queryExecution().toString().lower()


def test_daily_distribution_with_outlier(make_obs):
    rows = [{"hotel_name": "h", "price": p} for p in [1.0, 2.0, 3.0, 4.0, 100.0]]
    box = stats.daily_distribution(make_obs(rows)).first()
    assert (box["q1"], box["median_price"], box["q3"]) == (2.0, 3.0, 4.0)
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 4.0, 1)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 9), st.integers(0, 3)), min_size=1, max_size=60))
def test_pairs_match_a_plain_loop(make_obs, rows):
    obs = make_obs(
        [{"hotel_name": h, "price": float(p), "observed_at": at(f"2025-01-01T0{t}:00:00")} for h, p, t in rows]
    )
    want = []
    for hotel in "abc":
        line = sorted((t, i, p) for i, (h, p, t) in enumerate(rows) if h == hotel)
        want += [(hotel, float(a[2]), float(b[2])) for a, b in zip(line, line[1:])]
    got = as_set(changes.consecutive_pairs(obs, max_rows=9), "hotel_name", "old_price", "new_price")
    assert got == sorted(want, key=repr)

"""Points in intervals against comparing all with all."""

import math
import random

import pytest
from conftest import as_set

from faretide.operators.filters import tag_bands, tag_price_bands
from faretide.plans import ranges, shape

BANDS = "band string, low double, high double, note string"


def points(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, price double")


def brute(values, bands):
    out = []
    for i, v in enumerate(values):
        for name, low, high, _ in bands:
            if v is None or math.isnan(v) or any(e is not None and math.isnan(e) for e in (low, high)):
                continue
            if low is not None and high is not None and low > high:
                continue
            if (low is None or v >= low) and (high is None or v <= high):
                out.append((i, name))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_bands_of_all_widths(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(ranges, "attach", lambda a, b, on, how: shape.attach(a, b.hint("merge"), on, how, 0, 0))
    rng = random.Random(3)
    values = [rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9)), None, 0.0, -0.0]) for _ in range(300)]
    values += [math.nan, math.inf, -math.inf, 1e12, 1e-12]
    bands = []
    for k in range(200):
        low = rng.choice([None, rng.uniform(-60, 60), float(rng.randrange(-9, 9))])
        width = rng.choice([0.0, 1e-9, 0.5, 3.0, 64.0, 1e6])
        bands.append((f"b{k}", low, rng.choice([None, (low or 0) + width]), "n"))
    bands += [("all", None, None, ""), ("none", 5.0, 4.0, ""), ("nan", math.nan, 9.0, ""), ("far", 1e300, None, ""),
              ("inf", math.inf, math.inf, ""), ("below", None, -1e300, ""), ("point", 0.0, 0.0, "")]
    joined = ranges.range_join(points(spark, values), spark.createDataFrame(bands, BANDS), "price")
    assert joined.columns == ["id", "price", "band", "low", "high", "note"]
    assert as_set(joined, "id", "band") == brute(values, bands)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ("BroadcastHashJoin" in plan) == broadcast


def test_ten_thousand_bands_meet_few_wrong_points(spark):
    rng = random.Random(8)
    bands = [(f"b{k}", x := rng.uniform(0, 1e5), x + rng.choice([0.1, 2, 30]), "") for k in range(10_000)]
    values = [rng.uniform(0, 1e5) for _ in range(2000)]
    joined = ranges.range_join(points(spark, values), spark.createDataFrame(bands, BANDS), "price")
    assert as_set(joined, "id", "band") == brute(values, bands)


def test_totals_of_bands_without_their_rows(spark):
    """The same as joining and grouping, for shared names, ends and values too; no row per point and band is made."""
    rng = random.Random(5)
    values = [rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9)), None, 0.0, -0.0]) for _ in range(300)]
    values += [math.nan, math.inf, -math.inf, 1e12, 1e-12] + [7.0] * 500
    bands = [("all", None, None, ""), ("none", 5.0, 4.0, ""), ("nan", math.nan, 9.0, ""), ("far", 1e300, None, ""),
             ("inf", math.inf, math.inf, ""), ("below", None, -1e300, ""), ("point", 0.0, -0.0, ""), ("gap", 60.0, 70.0, "")]
    for k in range(300):
        low = rng.choice([None, rng.uniform(-60, 60), float(rng.randrange(-9, 9))])
        bands.append((f"b{k % 120}", low, rng.choice([None, (low or 0) + rng.choice([0.0, 1e-9, 0.5, 3.0, 64.0])]), "n"))
    held = {}
    for i, name in brute(values, bands):
        held.setdefault(name, []).append(values[i])
    want = sorted((name, len(v), min(v), max(v)) for name, v in held.items())
    for rows in (values, []):
        found = ranges.range_totals(points(spark, rows), spark.createDataFrame(bands, BANDS), "price")
        assert as_set(found, "band", "n", "least", "most") == (sorted(want, key=repr) if rows else [])


def test_totals_read_no_row_per_point_and_band(spark):
    """A thousand bands over a thousand prices: the ends and the distinct prices are the most that any step holds."""
    prices = points(spark, [float(k) for k in range(1000)])
    bands = spark.createDataFrame([(f"b{k}", 0.0, 1e6, "") for k in range(1000)], BANDS)
    totals = ranges.range_totals(prices, bands, "price")
    assert totals.filter("n <> 1000 or least <> 0 or most <> 999").count() == 0 and totals.count() == 1000
    assert "_level" not in totals._jdf.queryExecution().analyzed().toString()


def test_empty_sides_and_the_fixed_bands(spark):
    from faretide import fixed_values as fv

    none = spark.createDataFrame([], BANDS)
    assert ranges.range_join(points(spark, [1.0]), none, "price").count() == 0
    some = spark.createDataFrame([("a", 0.0, None, "")], BANDS)
    assert ranges.range_join(points(spark, []), some, "price").count() == 0
    assert ranges.range_join(points(spark, [None, math.inf]), some, "price").count() == 1
    prices = points(spark, [float(x) for x in range(0, 12_000, 250)])
    fixed = spark.createDataFrame(list(fv.PRICE_BANDS), "band string, low double, high double")
    assert as_set(tag_bands(prices, fixed), "id", "band") == as_set(tag_price_bands(prices), "id", "band")

"""Comparisons across airports."""

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from faretide.operators import airports


@pytest.fixture(scope="module")
def sides(make_obs):
    base = make_obs([{"hotel_name": h, "price": p} for h, p in [("A", 6000.0), ("A", 6100.0), ("B", 6500.0), ("C", 7000.0)]])
    other = make_obs(
        [
            {"hotel_name": h, "price": p, "offer_url": f"o{i}", "dates": f"d{i}"}
            for i, (h, p) in enumerate(
                [("A", 5500.0), ("B", 6500.0), ("C", 7200.0), ("D", 7000.0), ("E", 7800.0), ("A", 5500.0), ("F", 8000.5)]
            )
        ]
    )
    return base, other


def test_documented_case(sides):
    assert as_set(airports.missing_in_base(*sides), "hotel_name", "price") == [("D", 7000.0), ("E", 7800.0)]
    cheaper = airports.cheaper_alternatives(*sides)
    assert as_set(cheaper, "hotel_name", "savings", "best_offer_url", "best_dates") == [("A", 500.0, "o0", "d0")]


def test_alternatives_take_one_shuffle_and_leave_out_what_has_no_name(sides, make_obs):
    plan = airports.cheaper_alternatives(*sides)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan
    dear, cheap = (make_obs([{"hotel_name": None, "price": p}, {"hotel_name": "Z", "price": None}]) for p in (9.0, 1.0))
    assert airports.cheaper_alternatives(dear, cheap).count() == 0


def test_counters(sides):
    row = airports.comparison_summary(*sides).first().asDict()
    assert row == {
        "base_items_count": 3,
        "other_items_count": 6,
        "missing_count": 3,
        "missing_under_cap_count": 2,
        "cheaper_alternatives_count": 1,
    }


def test_item_sets(sides):
    both = airports.item_sets(*sides).filter("in_base and in_other")
    assert as_set(both, "hotel_name") == [("A",), ("B",), ("C",)]
    assert as_set(airports.items_only_in(*sides[::-1]), "hotel_name") == [("D",), ("E",), ("F",)]


def test_alternative_must_beat_the_latest_price(spark, sides):
    items = spark.createDataFrame([("A", 5400.0), ("B", 1.0)], "hotel_name string, price double")
    shown = airports.alternatives_for_items(items, airports.cheaper_alternatives(*sides))
    assert as_set(shown, "hotel_name", "alt_price") == [("A", None), ("B", None)]
    dearer = items.withColumn("price", F.lit(11000.0))
    row = airports.alternatives_for_items(dearer, airports.cheaper_alternatives(*sides)).filter("hotel_name = 'A'").first()
    assert (row["alt_savings"], row["alt_savings_percent"], row["alt_airport"]) == (5500.0, 50.0, "Другие аэропорты")


def test_same_trip_from_other_airports(make_obs):
    url = "https://search.example.com/?filter[from]="
    offers = [
        ("Sea  View", "24.09.2025 - 01.10.2025", "Krakow", 90.0, "k1"),
        ("sea view", "24-09-2025 - 1-10-2025", "Krakow", 80.0, ""),
        ("SEA VIEW ", "24.09.2025 - 01.10.2025", "Warszawa", 70.0, "w"),
        ("sea view", "24.09.2025 - 01.10.2025", "", 60.0, "u"),
        ("sea view", "24.09.2025 - 01.10.2025", "Lodz", 100.0, "l"),
        ("sea view", "25.09.2025 - 02.10.2025", "Lodz", 1.0, "l"),
    ]
    obs = make_obs(
        [{"hotel_name": h, "dates": d, "url": url + a, "price": p, "offer_url": o} for h, d, a, p, o in offers]
    )
    current = obs.filter("seq = 0").withColumn("price", F.lit(100.0)).withColumn("current_airport", F.lit("Варшава"))
    found = airports.cheaper_same_trip(obs, current)
    assert as_set(found, "airport", "alt_price", "savings_percent", "alt_url") == [
        ("Другой город", 60.0, 40.0, "u"),
        ("Краков", 80.0, 20.0, url + "Krakow"),
    ]
    assert as_set(airports.cheaper_same_trip(obs, current, 1), "airport") == [("Другой город",)]


def test_same_destination_and_dates(make_obs):
    def offer(slug, dates):
        return {"hotel_name": slug, "price": 1.0, "url": f"https://s.example/kierunek/{slug}/?x=1", "dates": dates, "offer_url": ""}

    base = make_obs([offer("egipt", "1.1.2025 - 8.1.2025")])
    other = make_obs([offer("egipt", "01-01-2025 - 08-01-2025"), offer("egipt", "2.1.2025 - 9.1.2025"), offer("grecja", "1.1.2025 - 8.1.2025")])
    assert as_set(airports.same_destination_and_dates(other, base), "seq") == [(0,)]

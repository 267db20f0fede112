"""Alert history, deduplication and the feed."""

import json

from conftest import as_set, at

from faretide.operators import alerts
from faretide.sources import alerts as source

KEYED = "unique_key string, hotel_name string, price_change double"


def test_new_alerts_once_and_null_keys_kept(spark):
    found = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("b", "y", 1.0), (None, "z", 1.0), (None, "z", 1.0)], KEYED)
    history = spark.createDataFrame([("a", "x", 1.0), (None, "q", 1.0)], KEYED)
    assert as_set(alerts.new_alerts(found, history), "unique_key", "hotel_name") == sorted(
        [("b", "y"), (None, "z"), (None, "z")], key=repr)


def test_missing_items(make_obs):
    history = make_obs(
        [
            {"hotel_name": "gone", "price": 5.0, "observed_at": at("2025-01-01T00:00:00")},
            {"hotel_name": "gone", "price": 6.0, "observed_at": at("2025-01-02T00:00:00")},
            {"hotel_name": "here", "price": 7.0},
        ]
    )
    current = make_obs([{"hotel_name": " here ", "price": 7.0}])
    rows = alerts.missing_items(history, current, 8100.0, "2025-01-03T00:00:00").collect()
    assert [(r["hotel_name"], r["old_price"], r["new_price"], r["unique_key"]) for r in rows] == [
        ("gone", 6.0, None, "gone_2025-01-02_00-00_missing")]
    assert rows[0]["note"].endswith("(вероятно цена > 8100 PLN либо предложение снято)")
    assert alerts.missing_items(history, current).first()["note"] == "Отель отсутствует в результатах поиска"


CURRENT = {"hotel_name": "n", "old_price": 10.0, "new_price": 9.0, "price_change": -1.0, "price_change_pct": -10.0,
           "timestamp": "2025-01-01T00:00:00", "alert_type": "price_drop", "created_at": "2025-01-05T00:00:00", "unique_key": "k1"}
LEGACY = {"hotel": "l", "from": 1.0, "to": 2.0, "time": "2025-01-06T00:00:00+02:00"}
MISSING = {"type": "missing", "hotel_name": "m", "old_price": 3.0, "new_price": None, "timestamp": "wczoraj", "note": "brak"}


def test_both_layouts(spark, tmp_path):
    (tmp_path / "bare.json").write_text(json.dumps([CURRENT, LEGACY], indent=1))
    (tmp_path / "doc.json").write_text(json.dumps({"alerts": [MISSING]}, indent=1))
    read = source.read_alerts(spark, str(tmp_path))
    assert as_set(read, "hotel_name", "old_price", "new_price", "alert_type") == [
        ("l", 1.0, 2.0, None), ("m", 3.0, None, "missing"), ("n", 10.0, 9.0, "price_drop")]
    feed = alerts.alert_feed(read).collect()
    assert [r["hotel_name"] for r in feed] == ["l", "n", "m"]
    shown = {r["hotel_name"]: r for r in alerts.feed_rows(read).collect()}
    assert (shown["m"]["change_text"], shown["m"]["price_text"]) == ("— brak", "3.0 → —")
    assert (shown["n"]["change_text"], shown["n"]["direction"]) == ("↓ -10.0%", "decrease")


def test_absent_history(spark, tmp_path):
    assert source.read_alerts(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "empty.json").write_text("{}")
    assert source.read_alerts(spark, str(tmp_path / "empty.json")).count() == 0


def test_appending_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    found = spark.createDataFrame([("a", "x", 1.0), ("b", "y", -1.0)], KEYED)
    source.append_alerts(found.limit(1), path)
    source.append_alerts(found, path)
    source.append_alerts(found, path)
    assert as_set(source.read_alert_table(spark, path), "unique_key") == [("a",), ("b",)]


def test_counts_and_top(spark):
    rows = [("d", f"k{i}", f"h{i}", float(c)) for i, c in enumerate([-3, -1, 5, 2, 0])]
    df = spark.createDataFrame(rows, "dataset string, unique_key string, hotel_name string, price_change double")
    assert tuple(alerts.alert_counts(df).first())[1:] == (5, 2, 2)
    assert as_set(alerts.top_alerts(df, 1), "side", "price_change") == [("drop", -3.0), ("increase", 5.0)]


def test_first_of_equal_keys_stays(spark):
    from faretide.operators.alerts import new_alerts

    rows = [("k", at("2025-01-02T00:00:00"), 1.0, 5.0), ("k", at("2025-01-01T00:00:00"), 2.0, 9.0), (None, None, 3.0, 3.0)]
    found = new_alerts(
        spark.createDataFrame(rows, "unique_key string, changed_at timestamp, old_price double, new_price double"),
        spark.createDataFrame([], "unique_key string"),
    )
    assert sorted((r["unique_key"] or "", r["old_price"]) for r in found.collect()) == [("", 3.0), ("k", 2.0)]

"""Consecutive changes, trailing windows, extremes and snapshots on small series."""

import math

from conftest import as_set, at

from faretide.operators import changes, stats, tables


def series(prices, hotel="h", start="2025-01-01T00:00:00", step_h=1):
    first = at(start)
    import datetime as dt

    return [
        {"hotel_name": hotel, "price": p, "observed_at": first + dt.timedelta(hours=step_h * i)}
        for i, p in enumerate(prices)
    ]


def test_threshold_is_inclusive(make_obs):
    obs = make_obs(series([100.0, 96.0], "four") + series([10000.0, 9601.0], "less") + series([5.0, 5.0], "same"))
    assert as_set(changes.consecutive_changes(obs), "hotel_name", "price_change_pct", "alert_type") == [
        ("four", -4.0, "price_drop")
    ]


def test_single_row_and_unusable_previous_price(make_obs):
    obs = make_obs(series([7.0], "one") + series([0.0, 9.0], "zero") + series([-5.0, 9.0], "negative"))
    assert changes.consecutive_pairs(obs).count() == 2
    assert changes.consecutive_changes(obs).count() == 0
    assert changes.consecutive_changes(obs, threshold=0.0).count() == 2


def test_equal_times_follow_seq(make_obs):
    rows = [{"hotel_name": "h", "price": p, "seq": s} for p, s in [(300.0, 3), (100.0, 1), (200.0, 2)]]
    pairs = changes.consecutive_pairs(make_obs(rows))
    assert as_set(pairs, "old_price", "new_price") == [(100.0, 200.0), (200.0, 300.0)]


def test_keys_and_created_at(make_obs):
    obs = make_obs(series([100.0, 112.5], "Hotel A"))
    row = changes.consecutive_changes(obs, created_at="2025-02-01T00:00:00").first()
    assert row["unique_key"] == "Hotel A_2025-01-01_01-00_12.5"
    assert row["created_at"] == "2025-02-01T00:00:00"
    assert row["threshold_percent"] == 4.0


def test_order_and_partitioning_do_not_matter(make_obs):
    rows = [
        {"hotel_name": f"h{i % 7}", "price": float(i * 37 % 101), "seq": i, "observed_at": at(f"2025-01-{1 + i % 20:02d}T00:00:00")}
        for i in range(200)
    ]
    plain = as_set(changes.consecutive_changes(make_obs(rows)), "unique_key")
    shuffled = make_obs(rows[::-1]).repartition(13)
    assert as_set(changes.consecutive_changes(shuffled), "unique_key") == plain


def test_window_edge_is_inclusive(make_obs):
    obs = make_obs(
        [
            {"hotel_name": "edge", "price": 100.0, "observed_at": at("2025-01-01T00:00:00")},
            {"hotel_name": "edge", "price": 90.0, "observed_at": at("2025-01-02T00:00:00")},
            {"hotel_name": "out", "price": 50.0, "observed_at": at("2024-12-31T23:59:59")},
            {"hotel_name": "out", "price": 60.0, "observed_at": at("2025-01-01T12:00:00")},
            {"hotel_name": "out", "price": 70.0, "observed_at": at("2025-01-01T13:00:00")},
        ]
    )
    found = as_set(changes.window_changes(obs, [24]), "hotel_name", "old_price", "new_price")
    assert found == [("edge", 100.0, 90.0), ("out", 60.0, 70.0)]


def test_window_falls_back_to_second_to_last_row(make_obs):
    old = series([10.0, 20.0, 30.0], "stale", "2024-06-01T00:00:00")
    one = series([5.0], "inside") + [{"hotel_name": "inside", "price": 4.0, "observed_at": at("2024-01-01T00:00:00")}]
    new = series([1.0], "newest", "2025-01-01T00:00:00")
    found = as_set(changes.window_changes(make_obs(old + one + new), [24]), "hotel_name", "old_price", "new_price")
    assert found == [("inside", 4.0, 5.0), ("stale", 20.0, 30.0)]


def test_window_without_change_or_with_zero_baseline(make_obs):
    obs = make_obs(series([0.0, 5.0], "zero") + series([5.0, 6.0, 5.0], "back") + series([7.0], "single"))
    assert changes.window_changes(obs, [24]).count() == 0


def test_movers_take_the_largest(make_obs):
    rows = []
    for i in range(8):
        rows += series([100.0, 100.0 + i], f"up{i}") + series([100.0, 100.0 - i], f"down{i}")
    top = changes.movers(make_obs(rows), [24], n=2)
    assert as_set(top, "side", "position", "hotel_name") == [
        ("decrease", 1, "down7"),
        ("decrease", 2, "down6"),
        ("increase", 1, "up7"),
        ("increase", 2, "up6"),
    ]


def test_new_minimum_and_maximum_together(make_obs):
    obs = make_obs(
        series([5.0], "only")
        + series([4.0, 6.0], "high")
        + series([9.0], "old", "2024-01-01T00:00:00")
    )
    labels = {r["hotel_name"]: r["labels"] for r in changes.extreme_labels(obs).collect()}
    assert labels["only"] == ["Новый минимум 7д", "Новый максимум 7д", "Новый минимум 30д", "Новый максимум 30д"]
    assert labels["high"] == ["Новый максимум 7д", "Новый максимум 30д"]
    assert labels["old"] == []


def test_snapshot_by_newest_time_and_by_newest_run(make_obs):
    obs = make_obs(
        [
            {"hotel_name": "a", "price": 1000.0, "observed_at": at("2025-01-01T00:00:00")},
            {"hotel_name": "b", "price": 1000.0, "observed_at": at("2025-01-01T00:00:01")},
            {"hotel_name": "a", "price": 1100.0, "observed_at": at("2025-01-01T01:00:00")},
            {"hotel_name": "b", "price": 1200.0, "observed_at": at("2025-01-01T01:00:01")},
        ]
    )
    assert as_set(changes.snapshot_changes(obs), "hotel_name", "price_change") == [("b", 200.0)]
    by_run = changes.snapshot_changes(obs, mode="last_run")
    assert as_set(by_run, "hotel_name", "price_change") == [("a", 100.0), ("b", 200.0)]


def test_watchlist_is_over_rows(make_obs):
    obs = make_obs(series([1.0, 2.0, 3.0], "cheap") + series([50.0, 60.0], "dear"))
    listed = stats.watchlist(obs, 3)
    assert as_set(listed, "hotel_name", "records", "status_color") == [("cheap", 3, "red")]


def test_mean_is_independent_of_partitioning(make_obs):
    rows = [{"hotel_name": "h", "price": 0.1 * (i % 97) + 1e5, "seq": i} for i in range(500)]
    means = {stats.kpis(make_obs(rows).repartition(n)).first()["mean_price"] for n in (1, 3, 17)}
    assert len(means) == 1
    assert math.isclose(means.pop(), sum(r["price"] for r in rows) / 500, rel_tol=1e-9)


def test_item_table_without_history(make_obs):
    rows = tables.item_rows(tables.item_table(make_obs(series([5.0], "Ą 1"))))
    row = rows.first()
    assert (row["slug"], row["price_text"], row["delta_text"], row["since_text"]) == ("1", "5 PLN", "—", "→ 0.0%")
    assert (row["dates"], row["airport"]) == ("20-09-2025 - 04-10-2025", "Варшава")


def test_means_of_any_price(make_obs):
    """More than two decimals count in full; NaN is a missing price."""
    from faretide.operators import stats

    obs = make_obs([{"price": 10.004}, {"price": 10.004}, {"price": float("nan")}, {"price": None}])
    assert stats.kpis(obs).first()["mean_price"] == 10.004
    assert stats.daily_stats(obs).first()["mean_price"] == 10.004

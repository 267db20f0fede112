"""Run segmentation and everything computed per run."""

import datetime as dt

from conftest import as_set, at

from faretide.operators import changes, topn
from faretide.plans.runs import run_prices, run_times, tag_runs


def test_gap_must_exceed_five_minutes(make_obs):
    times = [
        "2025-01-01T00:00:00",
        "2025-01-01T00:04:59",
        "2025-01-01T00:09:59",
        "2025-01-01T00:14:59.000001",
        "2025-01-01T00:14:59.000002",
    ]
    obs = make_obs([{"hotel_name": "h", "price": 1.0, "observed_at": at(t)} for t in times])
    runs = [r["run_id"] for r in tag_runs(obs).orderBy("observed_at").collect()]
    assert runs == [1, 1, 1, 2, 2]
    assert run_times(obs).count() == 2


def test_file_order_does_not_matter_and_datasets_are_apart(make_obs):
    rows = [
        {"dataset": d, "hotel_name": "h", "price": 1.0, "observed_at": at(f"2025-01-01T{h:02d}:{m:02d}:00")}
        for d, h, m in [("b", 3, 0), ("a", 2, 0), ("a", 0, 0), ("b", 0, 2), ("a", 0, 3), ("b", 2, 58)]
    ]
    got = as_set(run_times(make_obs(rows)), "dataset", "run_id", "run_start")
    assert [(d, r, s.strftime("%H:%M")) for d, r, s in got] == [
        ("a", 1, "00:00"),
        ("a", 2, "02:00"),
        ("b", 1, "00:02"),
        ("b", 2, "02:58"),
    ]


def test_runs_equal_a_plain_scan(make_obs):
    """Cells against the definition, with times around cell edges and before 1970."""
    base = at("1969-12-31T23:40:00")
    offsets, t = [], 0
    for i in range(400):
        t += (i * 7919) % 613
        offsets.append(t)
    rows = [{"hotel_name": "h", "price": 1.0, "observed_at": base + dt.timedelta(seconds=s)} for s in offsets]
    expected, run, last = [], 0, None
    for s in offsets:
        if last is None or s - last > 300:
            run += 1
        expected.append(run)
        last = s
    got = [r["run_id"] for r in tag_runs(make_obs(rows)).orderBy("observed_at", "seq").collect()]
    assert got == expected and run > 50


def runs_of(make_obs, *runs):
    """Each run is a dict hotel -> price, one hour apart."""
    rows = []
    for i, run in enumerate(runs):
        for hotel, price in run.items():
            rows.append({"hotel_name": hotel, "price": price, "observed_at": at(f"2025-01-01T{i:02d}:00:00")})
    return tag_runs(make_obs(rows))


def test_last_price_in_a_run_counts(make_obs):
    obs = make_obs(
        [
            {"hotel_name": "h", "price": 5.0, "observed_at": at("2025-01-01T00:00:00")},
            {"hotel_name": "h", "price": 6.0, "observed_at": at("2025-01-01T00:01:00")},
        ]
    )
    assert run_prices(tag_runs(obs)).first()["price"] == 6.0


def test_skipped_run_leaves_no_previous_price(make_obs):
    tagged = runs_of(make_obs, {"a": 100.0, "b": 100.0}, {"a": 100.0}, {"a": 90.0, "b": 50.0})
    assert as_set(changes.run_changes(tagged), "hotel_name", "unique_key") == [("a", "a_2025-01-01_02-00_-10.0")]
    trend = topn.trend_index(tagged)
    assert as_set(trend, "run_id", "avg_change_pct", "compared_items", "items") == [
        (2, 0.0, 1, 1),
        (3, -10.0, 1, 2),
    ]


def test_run_key_has_explicit_sign(make_obs):
    tagged = runs_of(make_obs, {"a": 100.0}, {"a": 105.0})
    assert changes.run_changes(tagged).first()["unique_key"] == "a_2025-01-01_01-00_+5.0"


def test_ties_at_the_cut(make_obs):
    prices = {f"h{i:02d}": float(i) for i in range(9)} | {"x1": 50.0, "x2": 50.0, "x3": 60.0}
    tagged = runs_of(make_obs, prices)
    strict = topn.top_members(tagged)
    assert strict.count() == 10 and strict.filter("hotel_name = 'x2'").count() == 0
    shared = topn.top_members(tagged, ties="shared")
    assert shared.count() == 11
    assert as_set(shared.filter("price = 50"), "hotel_name", "position") == [("x1", 10), ("x2", 10)]
    both = [topn.topn_index(tagged, ties=t).first() for t in ("strict", "shared")]
    assert both[0]["avg_price"] == both[1]["avg_price"] == (36 + 50) / 10
    assert (both[0]["members"], both[1]["members"]) == (10, 11)


def test_fewer_than_ten_items_are_all_members(make_obs):
    index = topn.topn_index(runs_of(make_obs, {"a": 1.0, "b": 4.0})).first()
    assert (index["avg_price"], index["members"], index["avg_change"]) == (2.5, 2, 0.0)


def test_diff_and_hover(make_obs):
    tagged = runs_of(make_obs, {"a": 1.0, "b": 2.0}, {"a": 1.0, "c": 3.0}, {"a": 1.0, "c": 3.0})
    diff = topn.topn_diff(tagged, n=2)
    assert as_set(diff, "run_id", "hotel_name", "kind") == [(2, "b", "left"), (2, "c", "entered")]
    hover = {r["run_id"]: r for r in topn.hover_records(tagged, n=2).collect()}
    assert [hover[i]["no_changes"] for i in (1, 2, 3)] == [True, False, True]
    assert hover[2]["title"] == "📊 ТОП-2 (2025-01-01 01:00)"
    assert [h["name"] for h in hover[2]["new_hotels"]] == ["c"]
    assert hover[2]["avg_move"]["arrow"] == "↑"


def test_corrected_last_run(make_obs):
    first = {f"h{i}": 10.0 + i for i in range(10)}
    tagged = runs_of(make_obs, first, {"h9": 1.0})
    assert topn.topn_index(tagged).filter("run_id = 2").first()["avg_price"] == 1.0
    fixed = topn.topn_index(tagged, correct_last=True).filter("run_id = 2").first()
    assert fixed["avg_price"] == (sum(10.0 + i for i in range(9)) + 1.0) / 10
    few = runs_of(make_obs, {"a": 2.0}, {"b": 1.0})
    assert topn.topn_index(few, correct_last=True).filter("run_id = 2").first()["avg_price"] == 1.0


def _one_run(make_obs, prices, start="2025-01-01T00:00:00"):
    begin = at(start)
    return [
        {"hotel_name": name, "price": p, "observed_at": begin + dt.timedelta(seconds=i)} for i, (name, p) in enumerate(prices)
    ]


def test_runs_of_fewer_items_share_positions(make_obs):
    prices = [("c", 5.0), ("a", 5.0), ("b", 3.0), ("d", 9.0)]
    tagged = tag_runs(make_obs(_one_run(make_obs, prices)))
    got = as_set(topn.top_members(tagged, n=5), "hotel_name", "position")
    assert got == [("a", 2), ("b", 1), ("c", 2), ("d", 4)]
    # With n items or more they are numbered, equal prices in name order.
    assert as_set(topn.top_members(tagged, n=4), "hotel_name", "position") == [("a", 2), ("b", 1), ("c", 3), ("d", 4)]
    assert as_set(topn.top_members(tagged, n=2), "hotel_name", "position") == [("a", 2), ("b", 1)]


def test_trend_changes_are_numbered_over_parts(make_obs, monkeypatch):
    from faretide.plans import shape

    names = [f"h{k:02d}" for k in range(23)]
    rows = _one_run(make_obs, [(n, float(10 + k)) for k, n in enumerate(names)])
    rows += _one_run(make_obs, [(n, float(11 + k) if k else 0.0) for k, n in enumerate(names[:20])], "2025-01-01T01:00:00")
    rows += _one_run(make_obs, [("h00", 7.0), ("h01", 12.0), ("new", 1.0)], "2025-01-01T02:00:00")
    for limit in (shape.SERIES_ROWS, 6):  # also with runs split into range blocks
        monkeypatch.setattr(topn, "running_total", lambda *a, limit=limit: shape.running_total(*a, max_rows=limit))
        lists = topn.trend_changes(tag_runs(make_obs(rows)), 8).orderBy("run_id", "part").collect()
        assert [(r["run_id"], r["part"], len(r["price_changes"])) for r in lists] == [(2, 0, 8), (2, 1, 8), (2, 2, 4), (3, 0, 1)]
        entries = [e for r in lists[:3] for e in r["price_changes"]]
        assert [(e["position"], e["name"]) for e in entries] == list(enumerate(names[:20], 1))
        assert entries[0][2:] == (10.0, 0.0, -100.0) and entries[1]["change_percent"] == 100 / 11
        # A price of zero before is not compared.
        assert [e["name"] for e in lists[3]["price_changes"]] == ["h01"]

"""The healing pair feed against the batch operators, over files in any order."""

import random
from collections import Counter

import pytest
from conftest import as_set, at

from faretide.operators.changes import consecutive_changes, consecutive_pairs
from faretide.streaming import ordered


@pytest.mark.parametrize("seed", range(40))
def test_inserted_and_replaced(seed):
    """Signs add up to the neighbours of all rows, whatever came when."""
    rng = random.Random(seed)
    rows = [(rng.randrange(30), k % 20, float(k)) for k in range(rng.randint(1, 60))]
    held, edges, signs = {}, [], Counter()
    while rows:
        batch, rows = rows[: rng.randint(1, 9)], rows[9:]
        updates = []
        for pane in {r[0] // 5 for r in batch}:
            fresh = sorted((r for r in batch if r[0] // 5 == pane), key=lambda r: r[:2])
            held[pane], changes = ordered.inserted(held.get(pane, []), fresh)
            signs.update({(a, b): 0 for _, a, b in changes})
            for sign, a, b in changes:
                signs[a, b] += sign
            updates.append((pane, len(held[pane]), held[pane][0], held[pane][-1]))
        rng.shuffle(updates)
        edges, changes = ordered.replaced(edges, updates + updates[:1])
        for sign, a, b in changes:
            signs[a, b] += sign
        every = [r for pane in sorted(held) for r in held[pane]]
        assert [r[:2] for r in every] == sorted(r[:2] for r in every)
        assert +signs == Counter(zip(every, every[1:])) and min(signs.values(), default=0) >= 0


def test_an_older_edge_changes_nothing():
    now = [(1, 5, (10, 0, 1.0), (19, 0, 2.0))]
    assert ordered.replaced(now, [(1, 4, (11, 0, 3.0), (18, 0, 4.0))]) == (now, [])


def test_one_late_row_gives_one_retraction_and_two_pairs():
    a, b, late = (1, 0, 1.0), (9, 0, 2.0), (5, 0, 3.0)
    merged, changes = ordered.inserted([a, b], [late])
    assert merged == [a, late, b] and sorted(changes) == [(-1, a, b), (1, a, late), (1, late, b)]


def batches(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(260):
        hotel = rng.choice(["hot", "hot", "a", "b"])
        minute = rng.randrange(6 * 24 * 60)
        when = f"2025-01-0{1 + minute // 1440}T{minute // 60 % 24:02d}:{minute % 60:02d}:00"
        price = rng.choice([None, 100.0, 104.0, 90.0, 0.0])
        rows.append({"hotel_name": hotel, "observed_at": at(when), "seq": k, "price": price})
    return [rows[i::5] for i in range(5)]


def test_feed_equals_batch_after_every_start(spark, make_obs, tmp_path):
    source, feed, state = (str(tmp_path / n) for n in ("in", "feed", "state"))
    assert ordered.read_feed(spark, feed).count() == 0
    for k, rows in enumerate(batches(1)):
        frame = make_obs(rows).select("dataset", "hotel_name", "price", "observed_at", "seq")
        frame.coalesce(1).write.mode("append").parquet(source)
        if k in (0, 2):  # further files wait for the next start
            continue
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ordered.feed_pairs(stream, feed, state, "12 hours")
        read, history = ordered.read_feed(spark, feed), spark.read.parquet(source)
        columns = ["hotel_name", "old_price", "new_price", "changed_at"]
        assert as_set(ordered.standing_pairs(read), *columns) == as_set(consecutive_pairs(history), *columns)
        alerts = ["hotel_name", "changed_at", "price_change_pct", "alert_type"]
        want = as_set(consecutive_changes(history), *alerts)
        assert as_set(ordered.standing_alerts(read), *alerts) == want
        net = Counter()
        for *alert, sign in as_set(ordered.signed_alerts(read), *alerts, "sign"):
            net[tuple(alert)] += sign
        assert sorted((+net).elements(), key=repr) == want
    assert ordered.read_feed(spark, feed).filter("sign = -1").count() > 20
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_rows_beyond_the_delay_are_dropped(spark, make_obs, tmp_path):
    source, feed, state = (str(tmp_path / n) for n in ("in", "feed", "state"))
    hours = [("10", 1.0), ("12", 2.0)], [("11", 3.0)], [("01", 4.0)]
    for k, rows in enumerate(hours):
        made = [{"hotel_name": "h", "observed_at": at(f"2025-01-01T{h}:00:00"), "seq": 10 * k + i, "price": p}
                for i, (h, p) in enumerate(rows)]
        frame = make_obs(made).select("dataset", "hotel_name", "price", "observed_at", "seq")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        ordered.feed_pairs(stream, feed, state, delay="3 hours")
    got = as_set(ordered.standing_pairs(ordered.read_feed(spark, feed)), "old_price", "new_price")
    assert got == [(1.0, 3.0), (3.0, 2.0)]


def test_a_batch_is_folded_without_a_call_per_pane(spark, make_obs, tmp_path):
    """No keyed state, so the cost of a batch is that of its rows; a repeated batch replaces what it wrote."""
    source, feed, state = (str(tmp_path / n) for n in ("in", "feed", "state"))
    rows = [{"hotel_name": f"h{k % 400}", "observed_at": at(f"2025-01-{1 + k % 20:02d}T0{k % 7}:00:00"), "seq": k, "price": float(k)}
            for k in range(2000)]
    frame = make_obs(rows).select("dataset", "hotel_name", "price", "observed_at", "seq")
    frame.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ordered.feed_pairs(stream, feed, state)
    assert not list((tmp_path / "state").rglob("state/0"))
    columns = ["hotel_name", "old_price", "new_price", "changed_at"]
    want = as_set(consecutive_pairs(frame), *columns)
    assert as_set(ordered.standing_pairs(ordered.read_feed(spark, feed)), *columns) == want
    again = spark.read.schema(ordered._ROWS).parquet(f"{feed}/rows").filter("ingest_batch = 1").drop("ingest_batch").localCheckpoint()
    ordered.fold_pairs(again, feed, 1)
    assert as_set(ordered.standing_pairs(ordered.read_feed(spark, feed)), *columns) == want

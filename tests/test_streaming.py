"""Streams over several micro-batches against the batch operators."""

import pytest
from conftest import as_set, at

from faretide.operators import changes
from faretide.sources.observations import read_observations, read_table
from faretide.streaming import windows
from faretide.streaming.alerts import alert_stream, append_new_alerts, pair_stream
from faretide.streaming.core import result_of, write_available
from faretide.streaming.ingest import ingest_files
from test_sources import HEADER, line

COLUMNS = ["hotel_name", "old_price", "new_price", "changed_at"]


@pytest.fixture(scope="module")
def replay(spark, make_obs, tmp_path_factory):
    """Write batches as files and stream them back one file at a time."""

    def run(*batches):
        path = tmp_path_factory.mktemp("in")
        for i, rows in enumerate(batches):
            make_obs(rows).select("dataset", "hotel_name", "price", "observed_at", "seq").coalesce(1).write.mode(
                "append"
            ).parquet(f"{path}/{i}")
        frames = spark.read.parquet(f"{path}/*")
        stream = (
            spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")
        )
        return stream, frames

    return run


def rows(hotel, start, prices, seq=0):
    return [
        {"hotel_name": hotel, "price": p, "observed_at": at(f"2025-01-01T{start + i:02d}:00:00"), "seq": seq + i}
        for i, p in enumerate(prices)
    ]


def test_state_carries_over_batches(spark, replay):
    stream, frames = replay(rows("a", 0, [100.0, 90.0]) + rows("b", 0, [50.0]), rows("a", 2, [80.0], 2), rows("b", 3, [60.0], 3))
    got = result_of(spark, alert_stream(stream), "t")
    assert as_set(got, *COLUMNS) == as_set(changes.consecutive_changes(frames), *COLUMNS)
    assert got.count() == 3


def test_late_rows_of_an_item_are_left_to_repair(spark, replay):
    stream, _ = replay(rows("a", 5, [100.0, 90.0]), rows("a", 5, [1.0], 0), rows("a", 7, [80.0], 9))
    got = result_of(spark, pair_stream(stream, "10 hours"), "t")
    assert as_set(got, "old_price", "new_price") == [(100.0, 90.0), (90.0, 80.0)]


def test_missing_after_timeout(spark, replay):
    stream, _ = replay(rows("a", 0, [5.0]) + rows("b", 0, [6.0]), rows("b", 20, [7.0], 5))
    got = result_of(spark, pair_stream(stream, "1 hour", missing_after_hours=4), "t")
    assert as_set(got.filter("kind = 'missing'"), "hotel_name", "old_price") == [("a", 5.0)]


def test_alerts_are_appended_once(spark, make_obs, tmp_path):
    keyed = make_obs(rows("a", 0, [1.0, 2.0])).selectExpr("concat('k', seq) AS unique_key", "hotel_name")
    keyed.write.parquet(str(tmp_path / "in"))
    for attempt in range(2):
        stream = spark.readStream.schema(keyed.schema).parquet(str(tmp_path / "in"))
        append_new_alerts(stream, str(tmp_path / "out"), str(tmp_path / f"state{attempt}"))
    assert as_set(spark.read.parquet(str(tmp_path / "out")), "unique_key") == [("k0",), ("k1",)]


def test_ingest_picks_up_new_files_only(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.csv").write_text(HEADER + "\n" + line(f"h{i}") + "\n")
        ingest_files(spark, str(source), table, state, "d")
    read = read_table(spark, table)
    assert as_set(read, "hotel_name", "price") == [("h0", 10.0), ("h1", 10.0), ("h2", 10.0)]
    assert [r["hotel_name"] for r in read.orderBy("seq").collect()] == ["h0", "h1", "h2"]
    batch = read_observations(spark, str(source), "d")
    assert as_set(batch, "hotel_name", "observed_at") == as_set(read, "hotel_name", "observed_at")


def test_repair_touches_only_late_days(spark, make_obs, tmp_path):
    from pyspark.sql import functions as F

    table, stats = str(tmp_path / "table"), str(tmp_path / "stats")
    obs = make_obs(
        [{"hotel_name": "h", "price": p, "observed_at": at(f"2025-01-0{d}T00:00:00")} for d, p in [(1, 1.0), (2, 2.0), (2, 4.0)]]
    ).withColumn("obs_date", F.to_date("observed_at"))
    obs.write.partitionBy("dataset", "obs_date").parquet(table)
    windows.repair_daily_stats(spark, table, stats, obs)
    late = obs.filter("price = 4.0").withColumn("price", F.lit(9.0))
    late.write.mode("append").partitionBy("dataset", "obs_date").parquet(table)
    windows.repair_daily_stats(spark, table, stats, late)
    assert as_set(spark.read.parquet(stats), "mean_price", "offers") == [(1.0, 1), (5.0, 3)]


def test_restart_continues(spark, replay, tmp_path):
    stream, _ = replay(rows("a", 0, [1.0]))
    out, state = str(tmp_path / "o"), str(tmp_path / "s")
    for _ in range(2):
        write_available(stream.select("hotel_name"), out, state)
    assert spark.read.parquet(out).count() == 1

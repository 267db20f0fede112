"""The stored run table against runs of the whole history, after every batch."""

import datetime as dt
import random

from conftest import as_set, at

from faretide.plans.runs import run_cells, run_times
from faretide.streaming import run_table

CELL = ["dataset", "_cell", "_first", "_last", "run_id", "run_start"]
RUN = ["dataset", "run_id", "run_start", "run_end"]


def history(make_obs, seed=7, n=240):
    rng = random.Random(seed)
    start = at("1969-12-30T00:00:00")
    rows, minutes = [], 0.0
    for k in range(n):
        minutes += rng.choice([0, 1, 4.9, 5, 5.1, 30, 400])
        rows.append({"dataset": rng.choice("aab"), "hotel_name": "h", "observed_at": start + dt.timedelta(minutes=minutes)})
    rng.shuffle(rows)
    return rows


def test_equal_after_every_batch(spark, make_obs, tmp_path):
    """Rows in any order; runs that begin in one block and end in another, and blocks without a start."""
    path, rows = str(tmp_path / "runs"), history(make_obs)
    assert run_table.stored_runs(spark, path).count() == 0
    for batch_id, a in enumerate(range(0, len(rows), 60)):
        run_table.fold_runs(make_obs(rows[a : a + 60]), path, batch_id)
        whole = make_obs(rows[: a + 60])
        assert as_set(run_table.stored_run_cells(spark, path), *CELL) == as_set(run_cells(whole), *CELL)
        assert as_set(run_table.stored_runs(spark, path), *RUN) == as_set(run_times(whole), *RUN)
    # A batch that is repeated changes nothing; the last days alone have the same numbers.
    run_table.fold_runs(make_obs(rows[180:]), path, 3)
    assert as_set(run_table.stored_run_cells(spark, path), *CELL) == as_set(run_cells(whole), *CELL)
    newest = max(r["observed_at"] for r in rows).date()
    late = run_table.stored_run_cells(spark, path, days=(newest, newest))
    every = as_set(run_cells(whole).filter(f"timestamp_micros(_first) >= date'{newest}'"), *CELL)
    assert every and set(every) <= set(as_set(late, *CELL)) and late.count() < run_cells(whole).count()


def test_a_late_row_joins_two_runs(spark, make_obs, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda t: {"hotel_name": "h", "observed_at": at(f"2025-01-0{t}:00")}
    run_table.fold_runs(make_obs([row(t) for t in ("1T23:57", "2T00:06", "3T10:00", "9T10:00")]), path, 0)
    assert [r["run_id"] for r in run_table.stored_runs(spark, path).orderBy("run_start").collect()] == [1, 2, 3, 4]
    run_table.fold_runs(make_obs([row("2T00:01")]), path, 1)
    runs = run_table.stored_runs(spark, path).orderBy("run_start").collect()
    assert [(r["run_id"], r["run_end"].day) for r in runs] == [(1, 2), (2, 3), (3, 9)]


def test_only_touched_blocks_are_read(spark, make_obs, tmp_path):
    """Also with many touched blocks, which are found by range and join."""
    path, rows = str(tmp_path / "runs"), history(make_obs, 9)
    run_table.fold_runs(make_obs(rows), path, 0)
    cells = run_table._stored(spark, f"{path}/cells", run_table._CELL)
    touched = cells.select("dataset", "block").distinct().orderBy("block").limit(2)
    some = run_table._of_blocks(cells, touched)
    # Filters on partition columns: folders of other blocks are pruned.
    assert "PartitionFilters: []" not in some._jdf.queryExecution().toString()
    want = as_set(cells.join(touched, ["dataset", "block"], "left_semi"), "dataset", "_cell")
    assert 0 < len(want) < cells.count() and as_set(some, "dataset", "_cell") == want
    named, run_table.NAMED_BLOCKS = run_table.NAMED_BLOCKS, 1
    try:
        assert as_set(run_table._of_blocks(cells, touched), "dataset", "_cell") == want
    finally:
        run_table.NAMED_BLOCKS = named


def test_odd_rows(spark, make_obs, tmp_path):
    path = str(tmp_path / "runs")
    run_table.fold_runs(make_obs([{"observed_at": None}, {"dataset": None}]), path, 0)
    run_table.fold_runs(make_obs([]), path, 1)
    assert run_table.stored_runs(spark, path).count() == 0
    run_table.fold_runs(make_obs([{"dataset": "a b/c=%d"}, {"dataset": ""}]), path, 2)
    assert [r["dataset"] for r in run_table.stored_runs(spark, path).collect()] == ["a b/c=%d"]

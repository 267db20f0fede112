"""Days that go from storage, and small files that become one."""

from conftest import at

from faretide.sources import observations, storage


def stored(spark, table):
    return sorted(map(str, observations.read_table(spark, table).collect()))


def files(spark, table):
    return {(r["folder"].split("dataset=")[1], r["files"]) for r in storage.day_folders(spark, table).collect()}


def test_small_files_and_old_days(spark, tmp_path, make_obs):
    days = [("a", "01-01"), ("a", "01-09"), ("a", "01-20"), ("b [x]/%=y", "06-01"), ("b [x]/%=y", "06-20"), ("007", "03-01")]
    obs = make_obs(
        [{"dataset": d, "hotel_name": f"{m} {k}", "observed_at": at(f"2025-{m}T00:00:00")} for d, m in days for k in range(3)]
    ).selectExpr("*", "to_date(observed_at) AS obs_date")
    table = str(tmp_path / "table")
    assert storage.compact_days(spark, table) == storage.drop_old_days(spark, table) == 0
    for k in range(3):
        observations.append_observations(obs.filter(f"hotel_name LIKE '% {k}'"), table)
    before = stored(spark, table)
    assert len(before) == 18 and {n for _, n in files(spark, table)} == {3}
    # The newest day of each dataset is left as it is.
    assert storage.compact_days(spark, table) == 3
    assert stored(spark, table) == before
    assert {n for f, n in files(spark, table) if "01-01" in f or "01-09" in f or "06-01" in f} == {1}
    assert storage.compact_days(spark, table) == 0
    kept = sorted(map(str, observations.retain(observations.read_table(spark, table), 11).collect()))
    assert storage.drop_old_days(spark, table, 11) == 2
    assert stored(spark, table) == kept and len(kept) == 12
    assert storage.drop_old_days(spark, table, 11) == 0

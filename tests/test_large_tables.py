"""Steps whose share of one task or of the driver must not grow with the tables."""

from faretide.operators import airports, filters
from faretide.plans import shape
from faretide.registry import airport_queries, document_queries


def test_ordered_files_are_written_by_many_tasks(spark, monkeypatch):
    written = []
    export = document_queries.source.export_csv
    monkeypatch.setattr(document_queries.source, "export_csv", lambda df, path: (written.append(df), export(df, path)))
    numbered = document_queries.s02(spark, "/root/testdata/sf0.001")
    assert len(written) == 2 and not any("Repartition" in d._jdf.queryExecution().analyzed().toString() for d in written)
    assert numbered.count() == numbered.select("seq").distinct().count() == written[0].count() + written[1].count()


def test_rows_of_hot_places_and_days_stay_where_they_are(spark, make_obs):
    """Few places and days serve all rows, so no task reads the rows of one of them."""
    link = "https://search.example.com/wycieczka/dest{},offer,1"
    rows = [{"hotel_name": "h", "dates": f"0{1 + k % 3}.05.2025 - 09.05.2025", "offer_url": link.format(k % 4), "url": ""} for k in range(60)]
    other, base = make_obs(rows), make_obs(rows[:2])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = airports.same_destination_and_dates(other, base)
        plan = same._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan.split("Initial Plan")[-1] and "Exchange hashpartitioning(_slug" not in plan
    assert same.columns == other.columns
    assert sorted(r["seq"] for r in same.collect()) == [k for k in range(60) if k % 4 < 2 and k % 3 < 2]


def test_blocks_of_heavy_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(shape, "MAX_BLOCKS", 7)
    rows = spark.range(3000).selectExpr("'d' AS k", "id AS t", "IF(id < 0, NULL, id * 2) AS v")
    _, heavy = shape.split_heavy(rows, ["k"], ["t"], max_rows=10)
    assert heavy.select("_block").distinct().count() <= 7
    lagged = shape.lag_in_series(rows, ["v"], ["k"], ["t"], max_rows=10)
    assert lagged.count() == 3000 and lagged.filter("NOT (prev_v <=> IF(t = 0, NULL, v - 2))").count() == 0


def test_rows_are_not_sorted_to_keep_or_drop_items(spark, make_obs, monkeypatch):
    """Rows of kept and dropped items stream past a table of the items, whether those are few or many."""
    rows = make_obs([{"hotel_name": n} for n in ["a", "b", "a", None, "c", "a"]])
    items = make_obs([{"hotel_name": n} for n in ["a", "c", "a", None, "x"]])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for small, join in ((True, "BroadcastHashJoin"), (False, "ShuffledHashJoin")):
            monkeypatch.setattr(filters, "is_small", lambda df, small=small: small)
            kept, dropped = filters.keep_items(rows, items), filters.drop_items(rows, items)
            for df in (kept, dropped):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert join in plan and "SortMergeJoin" not in plan
            assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 4, 5]
            assert sorted(r["seq"] for r in dropped.collect()) == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_are_made_for_chosen_offers_only(spark):
    """No text of an offer goes through the sort that finds the cheapest."""
    for query in (airport_queries.j02, airport_queries.j06, airport_queries.j06b):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        aggregates = [line for line in plan.split("\n") if "Aggregate" in line and "_offer" in line]
        below = plan[plan.index(aggregates[0]) + len(aggregates[0]) :]
        assert aggregates and "/kierunek/" not in below and "/wycieczka/" not in below and "dd.MM.yyyy" not in below

"""Pages from the index against the whole order."""

import random

import pytest

from faretide.operators import pages


@pytest.fixture(scope="module", params=[[("price", False), ("id", False)], [("price", True), ("id", False)]])
def stored(spark, request, tmp_path_factory):
    rng = random.Random(6)
    rows = [(k, rng.choice([1.0, 1.0, 1.0, 2.5, None, float(rng.randrange(90))]), f"n{k}") for k in range(500)]
    path = str(tmp_path_factory.mktemp("p") / "pages")
    pages.store_pages(spark.createDataFrame(rows, "id int, price double, name string"), path, request.param, 7)
    desc = request.param[0][1]
    rows.sort(key=lambda r: (r[1] is None, (-r[1] if desc else r[1]) if r[1] is not None else 0, r[0]))
    return path, request.param, rows


def test_pages_by_number(spark, stored):
    path, _, rows = stored
    for number, size in ((1, 50), (4, 50), (10, 50), (11, 50), (3, 7), (2, 499), (1, 1000)):
        got = pages.read_page(spark, path, number, size).collect()
        want = rows[(number - 1) * size : number * size]
        assert [(r["id"], r["price"], r["name"]) for r in got] == want
        assert [r["position"] for r in got] == list(range((number - 1) * size + 1, (number - 1) * size + 1 + len(want)))
        assert all(r["total"] == 500 for r in got)


def test_pages_by_key(spark, stored):
    path, order, rows = stored
    for at in (0, 1, 37, 120, 250, 340):
        if rows[at][1] is None:
            continue
        got = pages.read_after(spark, path, order, [rows[at][1], rows[at][0]], 50).collect()
        assert [(r["id"], r["position"]) for r in got] == [(r[0], at + 2 + k) for k, r in enumerate(rows[at + 1 : at + 51])]
    top = [1e9 if order[0][1] else -1.0, -1]
    assert [r["id"] for r in pages.read_after(spark, path, order, top, 5).collect()] == [r[0] for r in rows[:5]]


def test_only_the_parts_of_a_page_are_opened(spark, stored):
    path, _, _ = stored
    page = pages.read_page(spark, path, 5, 20)
    assert len(page.inputFiles()) >= 1
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(_part" in plan or "PartitionFilters: [_part" in plan or "_part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Window" not in plan
    assert page.select("position").count() == 20


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    pages.store_pages(spark.createDataFrame([], "id int, price double"), path, [("price", False), ("id", False)])
    assert pages.read_page(spark, path).count() == 0

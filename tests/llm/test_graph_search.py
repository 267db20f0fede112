"""Graph search against brute force: recall, ties, copies, dimensions, awkward vectors."""

import math

import numpy as np
import pytest

from faretide.llm import graph_search as gs

SCHEMA = "vec_id long, embedding array<float>, label int, shard long, ids long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def brute(rows: list[tuple], k: int, queries: list[tuple]) -> dict[int, list[tuple]]:
    ok = lambda v: v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
    good = sorted({(i, tuple(np.float32(x).item() for x in v)) for i, v in rows if i is not None and ok(v)})
    out = {}
    for q, v in queries:
        if q is None or not ok(v):
            continue
        a = np.array(v, np.float32).astype(float)
        near = [(float(np.sqrt(((a - np.array(w)) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v)]
        out[q] = sorted(near)[:k]
    return {q: n for q, n in out.items() if n}


def found(index, queries, k, **how) -> dict[int, list[tuple]]:
    got = {}
    for r in gs.nearest(index, queries, k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    return x.astype(np.float32)


@pytest.mark.parametrize("shard_nodes", [700, 10_000])
def test_recall(spark, points, shard_nodes):
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    table = frame(spark, rows)
    index = gs.build_index(table, 10, shard_nodes=shard_nodes)
    assert index.count() == 3000 and index.select("shard").distinct().count() == -(-3000 // shard_nodes)
    queries = rows[::25]
    want = brute(rows, 10, queries)
    got = found(index, frame(spark, queries), 10)
    again = found(index, frame(spark, queries), 10, query_share=30)
    assert got == again and got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.98 * 10 * len(want)
    exact = dict((i, np.array(v, np.float64)) for i, v in enumerate(points.astype(float)))
    assert all(s == np.sqrt(((exact[q] - exact[i]) ** 2).sum()) for q in got for s, i in got[q])


def test_edges_are_bounded_and_diverse(points):
    graph = gs.Graph(points, degree=16).build()
    counts = (graph.edges >= 0).sum(1)
    assert counts.max() <= 16 and counts.min() >= 1
    for node in range(0, 3000, 300):
        near = graph.edges[node][graph.edges[node] >= 0]
        assert node not in near and len(set(near.tolist())) == len(near)


def test_a_third_of_all_rows_share_a_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else rng.normal(size=2).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, [float(i % 5), 0.5]) for i in range(60)]
    want = brute(rows, 10, rows[::10])
    assert found(gs.build_index(frame(spark, rows), 10, shard_nodes=200), frame(spark, rows[::10]), 10) == want


def test_awkward_vectors(spark):
    bad = [(1, None), (2, [0.0, -0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [])]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [-0.0, 2.0]), (13, [0.0, 2.0]), (14, [3e38, -3e38]),
            (15, [1e-40, 0.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 4.0]), (30, [5.0]), (None, [1.0, 0.0])]
    index = gs.build_index(frame(spark, bad + good), 3)
    want = brute(bad + good, 3, bad + good)
    got = found(index, frame(spark, bad + good), 3)
    assert {q: [i for _, i in n] for q, n in got.items()} == {q: [i for _, i in n] for q, n in want.items()}
    assert 30 not in got and [i for _, i in got[20]] == [21]
    none = frame(spark, [])
    assert not found(gs.build_index(none, 3), frame(spark, good), 3) and not found(index, none, 3)
    assert not found(gs.build_index(frame(spark, bad), 3), frame(spark, bad), 3)

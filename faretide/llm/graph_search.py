"""Nearest neighbours by robust-pruned directed graphs, one per shard, searched with beams.

Equal vectors are one node that keeps their smallest ids, so a vector with a third of all rows is one node.
Nodes are dealt to shards of about ``SHARD_NODES`` by hash. In each shard a graph grows in rounds: a greedy search from
the entry node proposes neighbours for the new nodes of a round, and robust pruning keeps the nearest ones
in such a way that a candidate goes if a kept neighbour is nearer to it by the factor ``ALPHA``; edges back to new nodes are
added and pruned likewise. The first round joins all its nodes exhaustively.

The index is a table: one row per node with vector, ids and edges. A query is searched in every shard by a
beam of the nearest nodes seen; Euclidean distances of the beam are computed anew in double precision.
Queries pass each shard in batches, and when there are many, copies of a shard share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide.llm.frames import keep, runs

SHARD_NODES = 4096
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 192
ALPHA = 1.2
# Nodes that search the graph as it stands, together.
ROUND_NODES = 512
# Nodes whose candidates are compared with each other at once.
PRUNE_ROWS = 128
# Queries searched together, and queries that one copy of a shard serves.
QUERY_ROWS = 512
QUERY_SHARE = 20_000


def _clean(vectors: DataFrame, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, as arrays of double; the dimension beside."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    # A null component makes neither condition true.
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.filter("vec_id is not null and vector is not null").filter(finite).filter(
        F.exists("vector", lambda x: x != 0)
    )


def nodes(vectors: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """``vector, ids``: each distinct vector with its ``k + 1`` smallest ids.

    More ids of one vector can never be among a query's ``k`` nearest. Ranks are limited before rows are shuffled,
    so a vector that very many rows share sends few of them.
    """
    rows = _clean(vectors, vector)
    # Zeros of both signs are one number; the hash stands for the vector until the rows are few.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    least = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("at", F.dense_rank().over(least)).filter(F.col("at") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Graph:
    """A directed graph over the rows of ``x`` (single precision), with at most ``degree`` edges a node."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, edges: np.ndarray | None = None):
        self.x, self.norms, self.degree = x, _norms(x), degree
        self.edges = np.full((len(x), degree), -1, np.int32) if edges is None else edges
        self.entry = int(np.argmin(_norms(x - x.mean(0)))) if len(x) else 0

    def search(self, queries: np.ndarray, beam: int, entry: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and squared distances of the ``beam`` nearest nodes seen, nearest first, for each query.

        In each step every query expands its nearest two nodes not yet expanded, until there are none.
        """
        n, rows = len(queries), np.arange(len(queries))[:, None]
        own = _norms(queries)
        node = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.x)), bool)
        start = self.entry if entry is None else entry
        node[:, 0], open_[:, 0], seen[:, start] = start, True, True
        dist[:, 0] = np.maximum(own + self.norms[start] - 2 * queries @ self.x[start], 0)
        active = np.arange(n)
        while len(active):
            # The first two open places of each row.
            width = min(2, beam)
            places = np.argsort(~open_[active], axis=1, kind="stable")[:, :width]
            live = open_[active[:, None], places]
            picked = np.where(live, node[active[:, None], places], -1)
            open_[active[:, None], places] = False
            near = np.where(picked[:, :, None] >= 0, self.edges[picked], -1).reshape(len(active), -1)
            who = active[:, None]
            near = np.where((near >= 0) & ~seen[who, near], near, -1)
            # A node reached from both expanded nodes counts once.
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            found = near[r, c]
            seen[active[r], found] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = np.maximum(
                own[active[r]] + self.norms[found] - 2 * np.einsum("ij,ij->i", queries[active[r]], self.x[found]), 0
            )
            all_node = np.concatenate([node[active], near], axis=1)
            all_dist = np.concatenate([dist[active], d], axis=1)
            all_open = np.concatenate([open_[active], near >= 0], axis=1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            at = np.arange(len(active))[:, None]
            node[active], dist[active], open_[active] = all_node[at, best], all_dist[at, best], all_open[at, best]
            active = active[open_[active].any(axis=1)]
        return node, dist

    def prune(self, owners: np.ndarray, near: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """For each owner the diverse nearest of its candidates (nearest first, -1: none), at most ``degree``."""
        kept = np.full((len(owners), self.degree), -1, np.int32)
        bound = np.float32(alpha * alpha)
        for a in range(0, len(owners), PRUNE_ROWS):
            some = near[a : a + PRUNE_ROWS]
            alive = (some >= 0) & (some != owners[a : a + PRUNE_ROWS, None])
            vectors, norms = self.x[some], self.norms[some]
            between = norms[:, :, None] + norms[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
            # Whether the candidate of the row covers that of the column.
            covers = bound * np.maximum(between, 0) <= dist[a : a + PRUNE_ROWS, None, :]
            on = np.arange(len(some))
            for c in range(self.degree):
                first = np.argmax(alive[on], axis=1)
                on, first = on[alive[on, first]], first[alive[on, first]]
                if not len(on):
                    break
                kept[a + on, c] = some[on, first]
                alive[on, first] = False
                alive[on] &= ~covers[on, first]
        return kept

    def _ranked(self, owners: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of each owner by distance, each once; -1 last."""
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        d = self.norms[owners][:, None] + self.norms[near] - 2 * np.einsum("ijk,ik->ij", self.x[near], self.x[owners])
        d = np.where(near >= 0, np.maximum(d, 0), np.inf).astype(np.float32)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)

    def _link_back(self, owners: np.ndarray, alpha: float) -> None:
        """Edges back from the neighbours of ``owners``; a node with too many edges is pruned."""
        to = self.edges[owners].ravel()
        who = np.repeat(owners, self.degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, who = to[order], who[order]
        ends, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        # Nodes that very many new ones point to take them in shares, each pruned with what was kept before.
        for share in range(0, int(counts.max(initial=0)), 2 * self.degree):
            some = (place >= share) & (place < share + 2 * self.degree)
            held, at = np.unique(to[some], return_inverse=True)
            near = np.full((len(held), 3 * self.degree), -1, np.int32)
            near[:, : self.degree] = self.edges[held]
            near[at, self.degree + place[some] - share] = who[some]
            ranked, d = self._ranked(held, near)
            room = (ranked >= 0).sum(1) <= self.degree
            self.edges[held[room]] = ranked[room, : self.degree]
            if not room.all():
                self.edges[held[~room]] = self.prune(held[~room], ranked[~room], d[~room], alpha)

    def build(self, beam: int = BUILD_BEAM, alpha: float = ALPHA, together: int = ROUND_NODES) -> Graph:
        """Insert all nodes in rounds, the entry node first; a round doubles what is there, up to ``together``."""
        rest = np.delete(np.arange(len(self.x)), self.entry) if len(self.x) else np.zeros(0, np.int64)
        first, rest = np.append(self.entry, rest[: 2 * beam - 1]), rest[2 * beam - 1 :]
        if len(self.x) > 1:
            ranked, d = self._ranked(first, np.tile(first.astype(np.int32), (len(first), 1)))
            self.edges[first] = self.prune(first, ranked, d, alpha)
            self._link_back(first, alpha)
        there = len(first)
        while len(rest):
            step = min(there, together)
            fresh, rest = rest[:step], rest[step:]
            near, d = self.search(self.x[fresh], beam)
            self.edges[fresh] = self.prune(fresh, near, d, alpha)
            self._link_back(fresh, alpha)
            there += step
        return self


def _single(x: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in single precision, as parts of ``scale``; whatever their size, squares stay finite."""
    return np.clip(x / scale, -1e15, 1e15).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _build_shards(degree: int, beam: int, alpha: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "shard"):
            x = _matrix(group.column("vector"))
            graph = Graph(_single(x, np.abs(x).max()), degree).build(beam, alpha)
            edges = [e[e >= 0].tolist() for e in graph.edges]
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("shard").combine_chunks(),
                    pa.array(np.arange(len(x))),
                    pa.array(np.arange(len(x)) == graph.entry),
                    group.column("vector").combine_chunks(),
                    group.column("ids").combine_chunks(),
                    pa.array(edges, pa.list_(pa.int32())),
                ],
                ["shard", "node", "entry", "vector", "ids", "edges"],
            )

    return build


def build_index(
    vectors: DataFrame,
    k: int,
    vector: str = "embedding",
    shard_nodes: int = SHARD_NODES,
    degree: int = DEGREE,
    beam: int = BUILD_BEAM,
    alpha: float = ALPHA,
) -> DataFrame:
    """The stored graphs over all rows of ``vectors(vec_id, <vector>)`` that take part, for searches of up to ``k`` neighbours.

    Vectors that are null, zero, or hold null or non-finite components, and rows without id, take no part. Vectors of different
    dimensions stand in different shards and are never compared. Repeated rows count once.
    """
    found = keep(nodes(vectors, k, vector).withColumn("dim", F.size("vector")), "nodes")
    sizes = found.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard_nodes).alias("of"))
    before = F.sum("of").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    sizes = keep(sizes.withColumn("from", F.coalesce(before, F.lit(0))), "dims")
    shards = sizes.agg(F.sum("of")).first()[0] or 1
    # The table of dimensions has one row per vector length.
    dealt = found.join(sizes, "dim").withColumn("shard", F.col("from") + F.pmod(F.xxhash64("vector"), F.col("of")))
    placed = dealt.select("shard", "vector", "ids").repartitionById(int(shards), F.col("shard").cast("int"))
    index = placed.sortWithinPartitions("shard", F.element_at("ids", 1)).mapInArrow(
        _build_shards(degree, beam, alpha),
        "shard long, node long, entry boolean, vector array<double>, ids array<long>, edges array<int>",
    )
    return keep(index, "graphs")


def _search_shards(k: int, beam: int):
    names = ["query_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.float64()]

    def load(rows: pa.Table) -> tuple[Graph, float, np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(rows.column("vector"))
        edges = rows.column("edges").combine_chunks()
        degree = max(int(np.max(edges.value_lengths().to_numpy(), initial=1)), 1)
        table = np.full((len(x), degree), -1, np.int32)
        lengths = edges.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(x)), lengths)
        table[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = edges.flatten().to_numpy()
        scale = np.abs(x).max()
        graph = Graph(_single(x, scale), degree, table)
        graph.entry = int(np.argmax(rows.column("entry").to_numpy()))
        ids = rows.column("ids").combine_chunks()
        return graph, scale, x, ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])

    def answer(shard: tuple, query_id: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        graph, scale, x, ids, bounds = shard
        node, _ = graph.search(_single(q, scale), min(beam, len(x)))
        with np.errstate(over="ignore"):
            exact = np.sqrt(((q[:, None, :] - x[node]) ** 2).sum(-1))
        out = ([], [], [])
        for i in range(len(q)):
            order = np.argsort(exact[i], kind="stable")
            order = order[node[i][order] >= 0]
            sizes = bounds[node[i][order] + 1] - bounds[node[i][order]]
            # Enough nodes for k ids beside the query's own, and all others at the same distance as the last of them.
            enough = int(np.searchsorted(np.cumsum(sizes), k + 1)) + 1
            if enough < len(order):
                enough = int(np.searchsorted(exact[i][order], exact[i][order[enough - 1]], side="right"))
            order = order[:enough]
            got = np.concatenate([ids[bounds[v] : bounds[v + 1]] for v in node[i][order]])
            score = np.repeat(exact[i][order], sizes[:enough])
            other = got != query_id[i]
            got, score = got[other], score[other]
            best = np.lexsort((got, score))[:k]
            for column, values in zip(out, (np.full(len(best), query_id[i]), got[best], score[best])):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        shard, key = None, None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            nodes_ = batch.column("node").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (nodes_[1:] != nodes_[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if keys[a] != key:
                    held, shard, key = [], None, keys[a]
                if nodes_[a]:
                    held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                    continue
                if shard is None and held:
                    shard, held = load(pa.concat_tables(held)), []
                for c in range(a, b, QUERY_ROWS):
                    if shard is not None:
                        some = batch.slice(c, min(b, c + QUERY_ROWS) - c)
                        yield answer(shard, some.column("query_id").to_numpy(), _matrix(some.column("vector")))

    return search, "query_id long, vec_id long, score double"


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    vector: str = "embedding",
    beam: int = SEARCH_BEAM,
    query_share: int = QUERY_SHARE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row of ``queries(vec_id, <vector>)``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Rows with the query's own id are not
    its neighbours. Queries that take no part (see ``build_index``) and such without other rows of their dimension have no
    answers. Queries that repeat an id and vector count once; of different vectors with one id the nearest rows of any count.
    """
    asked = _clean(queries, vector).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id", "vector"])
    asked = keep(asked.withColumn("dim", F.size("vector")), "queries")
    copies = max(1, -(-asked.count() // query_share))
    # One row per shard.
    shards = index.groupBy("shard").agg(F.first(F.size("vector")).alias("dim"))
    shards = keep(shards, "shards")
    n = shards.agg(F.max("shard")).first()[0]
    keys = (0 if n is None else n + 1) * copies
    copy = F.array(*[F.lit(c) for c in range(copies)]) if copies <= 64 else F.sequence(F.lit(0), F.lit(copies - 1))
    rows = index.withColumn("copy", F.explode(copy)).select(
        (F.col("shard") * copies + F.col("copy")).alias("key"), "node", "entry", "vector", "ids", "edges",
        F.lit(None).cast("long").alias("query_id"),
    )
    sent = asked.join(shards, "dim").select(
        (F.col("shard") * copies + F.pmod(F.xxhash64("query_id"), F.lit(copies))).alias("key"),
        F.lit(None).cast("long").alias("node"),
        F.lit(None).cast("boolean").alias("entry"),
        "vector",
        F.lit(None).cast("array<long>").alias("ids"),
        F.lit(None).cast("array<int>").alias("edges"),
        "query_id",
    )
    dealt = rows.unionByName(sent).repartitionById(max(1, keys), F.col("key").cast("int"))
    found = dealt.sortWithinPartitions("key", F.col("node").asc_nulls_last()).mapInArrow(*_search_shards(k, beam))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

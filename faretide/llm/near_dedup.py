"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the distinct shingles of its lower-cased words. Independent trees branch
the documents by minwise shingles: a node holds the documents that share one, and a node with too many
documents branches again by further minwise functions. Documents of a small node are compared
exhaustively, first by their minwise values and then, where enough of these agree, on their full
sets. A node that is still too large at the last level (many copies of
one text) is compared in blocks that share two pivots. What is not connected after that meets by rare
shingles: in one fixed order of all shingles, rare ones first, two similar sets share one of their first few,
and how many these are follows from both sizes, so this finds every pair of the documents of too large nodes.
Each document gives a row per such shingle, however many copies there are. Shingles that only one document has, or
only documents that are connected already, are left out, and so are blocks whose sizes rule links out. No
node, partner or candidate is dropped.

With four trees of two branches each, a pair at similarity s is missed by all root nodes with
probability (1 - s)^8: 2.6e-6 at 0.8. How many of 24 minwise values must agree follows from the threshold, so that
a pair at the threshold fails with probability 1e-6 at most. Equal sets always meet: they are merged before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretide.llm.frames import free, grouped, keep, released
from faretide.llm.graph import components
from faretide.llm.words import mix, seeds, signed, slices

TREES = 4
BRANCHES = 2
DEPTH = 3
# Documents that one task compares with one another.
NODE_DOCS = 1024
# Bytes of text whose sets a task builds at a time.
CHUNK_BYTES = 4 << 20
# Minwise values of each set; two sets are compared in full if at least ``agreeing`` of them agree.
FUNCTIONS = 24
# How likely a pair at the threshold may fail that.
MISSED = 1e-6
# Columns of the incidence matrix that are held at a time.
_COLUMNS = 4096
# Counters of shingles, which tell rare from frequent ones.
COUNTERS = 1 << 20


def _set_table(shingle: int, functions: int):
    """Batches of (doc_id, text, text_key) -> size, 128-bit key and minwise values of each set."""
    salts = seeds(functions, 77)
    s1, s2 = seeds(2, 99)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in slices(batch.column(1), lower=True):
                values, bounds = words.shingles(shingle)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                at = bounds[:-1][some]
                columns = [x.slice(a, b - a).take(pa.array(some)) for x in (ids, batch.column(2))] + [pa.array(size[some])]
                if len(some):
                    columns += [pa.array(signed(np.add.reduceat(mix(values ^ s), at))) for s in (s1, s2)]
                    columns += [pa.array(signed(np.minimum.reduceat(mix(values ^ s), at))) for s in salts]
                else:
                    columns += [pa.array([], pa.int64())] * (2 + functions)
                names = ["doc_id", "text_key", "n_shingles", "k1", "k2", *[f"m{i}" for i in range(functions)]]
                yield pa.RecordBatch.from_arrays(columns, names)

    columns = ", ".join(f"m{i} long" for i in range(functions))
    return build, f"doc_id long, text_key long, n_shingles long, k1 long, k2 long, {columns}"


def similar(values: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of the sets have 100 * intersection >= percent * union, as a square matrix."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(np.int64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    ranked, owner = values[order], owner[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    token = np.cumsum(fresh) - 1
    shared = np.bincount(token)[token] > 1
    owner, token = owner[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    width = int(token.max()) + 1 if len(token) else 0
    for a in range(0, width, _COLUMNS):
        i, j = np.searchsorted(token, [a, a + _COLUMNS])
        block = np.zeros((n, min(_COLUMNS, width - a)), np.float32)
        block[owner[i:j], token[i:j] - a] = 1
        common += block @ block.T
    common = common.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    near = 100 * common >= percent * union
    np.fill_diagonal(near, True)  # ``common`` leaves out what only one set holds
    return near


def _smallest_linked(near: np.ndarray) -> np.ndarray:
    """Index of the first member of each row's component."""
    label = np.arange(len(near))
    while True:
        fresh = np.where(near, label[None, :], len(near)).min(axis=1)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [words.shingles(shingle) for _, _, words in slices(texts, lower=True)]
    size = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([v for v, _ in parts]), np.concatenate([[0], np.cumsum(size)])


def _linked(texts: pa.Array, shingle: int, percent: int) -> np.ndarray:
    """``similar`` of all texts; sets of at most two chunks of texts are held at a time."""
    ends = np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1).tolist(), len(texts)]
    near = np.zeros((len(texts), len(texts)), bool)
    spans = list(zip(cuts[:-1], cuts[1:]))
    for i, (a, b) in enumerate(spans):
        v, w = _sets(texts.slice(a, b - a), shingle)
        near[a:b, a:b] = similar(v, w, percent)
        for c, d in spans[i + 1 :]:
            x, y = _sets(texts.slice(c, d - c), shingle)
            both = similar(np.concatenate([v, x]), np.concatenate([w, y[1:] + w[-1]]), percent)
            near[a:b, c:d] = both[: b - a, b - a :]
            near[c:d, a:b] = near[a:b, c:d].T
    return near


def agreeing(percent: int, functions: int = FUNCTIONS, missed: float = MISSED) -> int:
    """Most minwise values that a pair at similarity ``percent`` % fails to agree on with probability ``missed`` at most."""
    p, below, k = percent / 100, 0.0, 0
    while k < functions:
        below += math.comb(functions, k) * p**k * (1 - p) ** (functions - k)
        if below > missed:
            break
        k += 1
    return k


def _promising(least: int):
    """Groups of (node, doc_id, minwise values) -> the parts of each group whose values agree, by (node, part)."""
    return lambda groups: _agreeing_parts(groups, least)


def _agreeing_parts(groups: Iterator[pa.Table], least: int) -> Iterator[pa.RecordBatch]:
    for group in groups:
        ids = group.column("doc_id").to_numpy()
        values = np.column_stack([group.column(c).to_numpy() for c in group.schema.names if c.startswith("m")])
        ids, order = np.unique(ids, return_index=True)  # pivots may stand twice in a block
        values = values[order]
        agree = np.zeros((len(ids), len(ids)), np.int8)
        for column in values.T:
            agree += column[:, None] == column[None, :]
        near = agree >= least
        np.fill_diagonal(near, True)
        root = _smallest_linked(near)
        kept = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        nodes = group.column("node").to_numpy()[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[kept]), pa.array(ids[root[kept]]), pa.array(ids[kept])], ["node", "part", "doc_id"]
        )


def _compare(shingle: int, percent: int):
    """Groups of (node, doc_id, text) -> links that connect what is similar in each group."""

    def build(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            group = group.combine_chunks()
            ids, first = np.unique(group.column("doc_id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            texts = group.column("text").take(pa.array(first)).combine_chunks()
            near = _linked(texts, shingle, percent)
            root = _smallest_linked(near)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"]
                )

    return build


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)


def _tally(shingle: int):
    """Batches with ``text`` -> how many sets have a shingle of each counter."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, words in slices(batch.column("text"), lower=True):
                counts += np.bincount(_counter(words.shingles(shingle)[0]), minlength=COUNTERS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])

    return build


def first_shingles(values: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the order of (level, value), and the largest set that each may link it with.

    Sets of x and y shingles are similar if they share at least percent * (x + y) / (100 + percent). If the
    first one that they share has i others before it in the one, they share at most x - i. Shingles of level 0 are in no
    other set.
    """
    size = len(values)
    order = np.lexsort((values, level))
    largest = (100 + percent) * (size - np.arange(size)) // percent - size
    some = (100 * largest >= percent * size) & (level[order] > 0)
    return values[order[some]], largest[some]


def _meeting(shingle: int, percent: int, level: np.ndarray):
    """Batches of (doc_id, label, text) -> a row per document and first shingle, with the sizes of its set and of the largest partner."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in slices(batch.column("text"), lower=True):
                values, bounds = words.shingles(shingle)
                levels, size = level[_counter(values)], np.diff(bounds)
                found = [first_shingles(values[i:j], levels[i:j], percent) for i, j in zip(bounds[:-1], bounds[1:])]
                count = [len(v) for v, _ in found]
                row = pa.array(np.repeat(np.arange(a, b), count))
                columns = [batch.column(c).take(row) for c in ("doc_id", "label")]
                columns += [pa.array(signed(np.concatenate([v for v, _ in found])))]
                columns += [pa.array(np.repeat(size, count)), pa.array(np.concatenate([x for _, x in found]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "node", "size", "largest"])

    return build


def _count_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of at least two documents; of nodes with the same members one is kept."""
    counted = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x1"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x2"),
    )
    return counted.filter("n > 1").groupBy("n", "x1", "x2", "low", "high").agg(F.min("node").alias("node"))


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """Children of too large nodes: one more minwise function, and a second for some nodes.

    The second comes with probability 0.25, so that a pair at similarity 0.8 is expected to stay
    together in one child (1.25 * 0.8 = 1).
    """
    mins = F.array(*[F.col(f"m{i}") for i in range(FUNCTIONS)])

    def child(branch: int):
        chosen = F.pmod(F.xxhash64("node", F.lit(level), F.lit(branch)), F.lit(FUNCTIONS)).cast("int")
        return F.xxhash64("node", F.lit(branch), F.element_at(mins, chosen + 1))

    second = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(4)) == 0
    children = F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0)))
    return rows.select("doc_id", F.explode(children).alias("node"))


def _blocks(members: DataFrame, docs_per_block: int) -> DataFrame:
    """Members of too large nodes in blocks; the two pivots of a node stand in every block."""
    blocks = F.ceil(F.col("n") / docs_per_block)
    inner = members.select(
        "doc_id", F.xxhash64("node", F.pmod(F.xxhash64("doc_id", "node"), blocks)).alias("node")
    )
    nodes = members.select("node", "n", "low", "high").distinct()
    pivots = nodes.select(
        F.explode(F.array("low", "high")).alias("doc_id"), "node", blocks.alias("b")
    ).select("doc_id", F.col("node"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("k"))
    return inner.union(pivots.select("doc_id", F.xxhash64("node", F.col("k").cast("long")).alias("node")))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    trees: int = TREES,
    branches: int = BRANCHES,
    depth: int = DEPTH,
    node_docs: int = NODE_DOCS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document of ``docs(doc_id, text)``.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets.
    ``component_id`` is the smallest doc_id that links reach. Texts without words (null, empty, white space) have
    the empty set and are linked with nothing. A text with fewer words than ``shingle`` has its whole
    sequence as its only shingle. Rows that repeat a doc_id count as one document and give
    one row, with the values of the larger set; rows without doc_id form one kept row with null
    ids if there are any. Of unlike texts under one id the largest set counts, of sets of one size that with the
    greatest hash. Other columns are ignored, whatever their names.
    """
    roots = trees * branches
    if roots > FUNCTIONS:
        raise ValueError(f"trees * branches must be at most {FUNCTIONS}")
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    build, schema = _set_table(shingle, FUNCTIONS)
    sets = keep(texts.mapInArrow(released(build), schema), "sets")
    # Of unlike texts under one id the one with the largest set counts; there are few such ids, mostly none.
    own = F.struct("n_shingles", "k1", "k2", "text_key")
    mixed = (
        sets.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(own).alias("best"), F.min(own).alias("least"))
        .filter("best <> least")
        .select("doc_id", "best")
    )
    sets = sets.join(mixed, "doc_id", "left").filter(F.col("best").isNull() | (F.col("best") == own)).drop("best")
    mins = [f"m{i}" for i in range(FUNCTIONS)]

    distinct = keep(
        sets.filter("doc_id is not null")
        .groupBy("k1", "k2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("first"), *[F.min(m).alias(m) for m in mins])
        .select("first.*", "k1", "k2", "n_shingles", *mins),
        "distinct",
    )
    slot = F.posexplode(F.array(*mins[:roots])).alias("slot", "value")
    rows = distinct.select("doc_id", slot).select("doc_id", F.xxhash64("slot", "value").alias("node"))
    small, large = [], None
    used: list[DataFrame] = []
    for level in range(depth):
        nodes = keep(_count_nodes(rows), "nodes")
        used.append(nodes)
        fine = nodes.filter(F.col("n") <= node_docs)
        small.append(rows.hint("merge").join(fine.select("node"), "node").select("doc_id", "node"))
        over = nodes.filter(F.col("n") > node_docs)
        if not over.limit(1).count():
            break
        wide = rows.join(over.select("node", "n", "low", "high"), "node")
        if level + 1 == depth:
            large = keep(wide.select("doc_id", "node", "n", "low", "high"), "large")
            small.append(_blocks(large, node_docs // 2))
        else:
            rows = keep(_branch(wide.join(distinct, "doc_id"), level), "branches")
            used.append(rows)
    members = small[0]
    for part in small[1:]:
        members = members.union(part)

    def promising(groups: DataFrame) -> DataFrame:
        """Members of the parts of each group that need a full comparison."""
        placed = groups.join(distinct.select("doc_id", *mins), "doc_id")
        parts = keep(grouped(placed, "node", _promising(agreeing(percent)), "node long, part long, doc_id long"), "parts")
        parts = parts.select(F.xxhash64("node", "part").alias("node"), "doc_id")
        # Parts with the same documents, mostly one and the same group found in several nodes, count once.
        return keep(parts.join(_count_nodes(parts).select("node"), "node").distinct(), "chosen")

    def compare(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
        return grouped(candidates.join(chosen, "doc_id"), "node", _compare(shingle, percent), "a long, b long")

    chosen = promising(members)
    wanted = chosen.select("doc_id") if large is None else chosen.select("doc_id").union(large.select("doc_id"))
    wanted = distinct.select("doc_id", "text_key").join(wanted.distinct(), "doc_id", "left_semi")
    # The texts are by far the larger side and go once through a shuffle at any size; repeated rows count once.
    candidates = keep(
        texts.hint("merge")
        .join(wanted, ["doc_id", "text_key"], "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.first("text").alias("text"))
        .select("doc_id", "text"),
        "candidates",
    )
    free(spark, *used)
    links = keep(compare(chosen, candidates), "found")
    same = components(links)
    if large is not None:
        rest = keep(_unconnected(_shared(large, same, candidates, shingle, percent), node_docs // 2), "rest")
        if rest.limit(1).count():
            links = links.union(keep(compare(promising(rest), candidates), "found"))
            same = components(links)
    free(spark, candidates)
    by_set = keep(
        distinct.select("k1", "k2", "n_shingles", "doc_id")
        .join(same, F.col("doc_id") == F.col("node"), "left")
        .select("k1", "k2", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")),
        "by_set",
    )
    found = (
        sets.select("doc_id", "k1", "k2", "n_shingles")
        .join(by_set, ["k1", "k2", "n_shingles"])
        .select("doc_id", "n_shingles", "component_id")
    )
    bare = texts.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    one = found.union(bare).groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.min("component_id")).alias("component_id"),
    )
    return one.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _shared(large: DataFrame, same: DataFrame, candidates: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, label, node, size, largest``: documents of too large nodes by first shingles that unlike components share."""
    label = F.coalesce("component", "doc_id").alias("label")
    labels = large.select("doc_id").distinct().join(same, F.col("doc_id") == F.col("node"), "left").select("doc_id", label)
    texts = keep(candidates.join(labels, "doc_id").select("doc_id", "label", "text"), "unsettled")
    # At most a row per counter reaches the driver; a counter of 1 is a shingle of one set only.
    tally = texts.mapInArrow(released(_tally(shingle)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    tally = tally.filter("n > 1").toArrow()
    level = np.zeros(COUNTERS, np.uint8)
    level[tally.column("slot").to_numpy()] = np.minimum(np.round(6 * np.log2(tally.column("n").to_numpy())), 255)
    build = _meeting(shingle, percent, level)
    rows = keep(
        texts.mapInArrow(released(build), "doc_id long, label long, node long, size long, largest long"), "meeting"
    )
    mixed = rows.groupBy("node").agg((F.min("label") < F.max("label")).alias("mixed")).filter("mixed")
    return rows.join(mixed.select("node"), "node")


def _unconnected(members: DataFrame, docs_per_block: int) -> DataFrame:
    """Pairs of blocks of ``members(doc_id, label, node, size, largest)`` that may hold links between components.

    Documents of a component with many members in a node stand in blocks of their own, and pairs of blocks of one
    component are left out. A block holds sets of about one size and largest partner; pairs of blocks whose sizes
    are too large for one another are left out too.
    """
    members = keep(members.select("doc_id", "label", "node", "size", "largest"), "members")
    many = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") * 8 >= docs_per_block)
    bands = [F.floor(F.log(F.col(c)) * 32).alias(f"{c}_band") for c in ("size", "largest")]
    placed = members.join(many, ["node", "label"], "left").select(
        "node", "doc_id", "size", "largest", F.when(F.col("m").isNotNull(), F.col("label")).alias("own"), *bands
    )
    cell = ["node", "own", "size_band", "largest_band"]
    # A cell with more than a block of documents is cut.
    counted = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = placed.join(counted.withColumnRenamed("own", "o"), ["node", "size_band", "largest_band"]).filter(
        F.col("own").eqNullSafe(F.col("o"))
    )
    k = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / docs_per_block))
    block = F.xxhash64(F.coalesce("own", F.lit(-1)), "own", "size_band", "largest_band", k).alias("block")
    cut = keep(cells.select("node", "doc_id", "own", "size", "largest", block), "cut")
    blocks = keep(
        cut.groupBy("node", "own", "block").agg(
            F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.max("largest").alias("largest")
        ),
        "blocks",
    )
    other = blocks.select("node", *[F.col(c).alias(f"{c}2") for c in ("own", "block", "n", "size", "largest")])
    # A row per pair of blocks that may hold links, which are few beside the documents of large components.
    pairs = blocks.join(other, "node").filter(
        (F.struct("n", "block") >= F.struct("n2", "block2"))
        & (F.col("size") <= F.col("largest2"))
        & (F.col("size2") <= F.col("largest"))
        & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False))
    )
    # The smaller blocks come to the larger one together, about a block of documents at a time.
    beside = F.ceil(F.sum("n2").over(Window.partitionBy("node", "block")) / docs_per_block)
    group = F.xxhash64("node", "block", F.pmod(F.xxhash64("block2"), beside)).alias("group")
    pairs = keep(pairs.select("node", "block", "block2", group), "pairs")
    left = pairs.select("node", "block", "group").distinct()
    right = pairs.filter("block <> block2").select("node", F.col("block2").alias("block"), "group")
    return cut.join(left.union(right), ["node", "block"]).select("doc_id", F.col("group").alias("node"))

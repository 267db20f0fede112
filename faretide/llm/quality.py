"""Quality of documents by histogram gradient-boosted trees over statistics of the text.

Training rows are a bounded sample of the labelled documents. Statistics are cut into at most 64
bins, trees are grown level by level from per-bin sums of gradients, and the forest is kept as flat
arrays (split statistic, split bin, leaf value), so that scoring a batch is a few array look-ups per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide.llm.frames import released
from faretide.llm.labelled import held_out, plain_texts, training_labels
from faretide.llm.words import column_bytes, slices

# Labelled documents that a model is fitted on at most.
TRAINING_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
# Second-order weight added to each leaf, and least weight of a leaf.
SMOOTHING = 1.0
LEAF_WEIGHT = 2.0

# Classes of bytes; each class gives a statistic, its share of all bytes.
_CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "comma", "bang", "bar", "mark", "quote", "high", "other"]
_CLASS_OF = np.full(256, _CLASSES.index("other"), np.int64)
for _name, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t", "line": b"\r\n",
    "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|", "mark": b"*&%$#@~^_=+<>{}[]\\/", "quote": b"'\"()-",
    "high": range(128, 256),
}.items():
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)
_UPPER, _LINE, _MARK = (_CLASSES.index(c) for c in ("upper", "line", "mark"))


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics per text. All are finite; a text without words has zeros."""
    data, offsets = column_bytes(texts)
    out = []
    for a, b, words in slices(texts):
        n = b - a
        part = data[offsets[a] : offsets[b]]
        size = np.diff(offsets[a : b + 1])
        owner = np.repeat(np.arange(n), size)
        kinds = _CLASS_OF[part]
        counts = np.bincount(owner * len(_CLASSES) + kinds, minlength=n * len(_CLASSES)).reshape(n, -1)
        count = words.counts
        word_owner = np.repeat(np.arange(n), count)
        length = words.end - words.begin
        share = lambda x, y: x / np.maximum(y, 1)
        per_word = lambda x: share(np.bincount(word_owner, x, n), count)
        mean = per_word(length)
        same = np.zeros(len(length), bool)
        same[1:] = words.hash[1:] == words.hash[:-1]
        same[words.first[:-1][count > 0]] = False
        last = kinds[words.end - 1]
        rows = [
            np.log1p(size),
            np.log1p(count),
            mean,
            np.sqrt(np.maximum(per_word(length.astype(float) ** 2) - mean**2, 0)),
            share(np.diff(words.shingles(1)[1]), count),
            share(np.diff(words.shingles(2)[1]), count),
            share(np.diff(words.shingles(4)[1]), count),
            per_word(same),
            per_word(last == _MARK),
            per_word(kinds[words.begin] == _UPPER),
            per_word(length == 1),
            per_word(length > 15),
            share(count, counts[:, _LINE] + 1),
        ]
        out.append(np.column_stack([*rows, share(counts, size[:, None])]))
    return np.concatenate(out) if out else np.zeros((0, 13 + len(_CLASSES)))


@dataclass(frozen=True)
class Forest:
    """Flat trees: node k of a tree has its children at 2k + 1 and 2k + 2."""

    edges: np.ndarray  # (statistics, BINS - 1)
    split: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray  # same; goes right if the bin is greater
    leaf: np.ndarray  # (trees, 2^depth)
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if not len(x):
            return np.zeros(0)
        trees, inner = self.split.shape
        binned, tree = self.bins(x), np.arange(trees)
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            value = np.take_along_axis(binned, self.split[tree, node], axis=1)
            node = 2 * node + 1 + (value > self.cut[tree, node])
        total = self.start + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for labels 0 and 1. Without rows of both labels the score is constant."""
    n, width = x.shape
    rate = (y.sum() + 1) / (n + 2)
    start = float(np.log(rate / (1 - rate)))
    inner = (1 << depth) - 1
    if not n or not 0 < y.sum() < n:
        return Forest(np.zeros((width, BINS - 1)), np.zeros((1, inner), int), np.zeros((1, inner), int), np.zeros((1, inner + 1)), start)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T.copy()
    forest = Forest(edges, np.zeros((trees, inner), int), np.full((trees, inner), BINS), np.zeros((trees, inner + 1)), start)
    binned = forest.bins(x)
    place = np.arange(width) * BINS + binned
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, base = 1 << level, (1 << level) - 1
            at = ((node - base)[:, None] * width * BINS + place).ravel()
            shape = (nodes, width, BINS)
            g = np.bincount(at, np.repeat(gradient, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(weight, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SMOOTHING) + (g_all - g) ** 2 / (h_all - h + SMOOTHING) - g_all**2 / (h_all + SMOOTHING)
            gain[(h < LEAF_WEIGHT) | (h_all - h < LEAF_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            forest.split[t, base : base + nodes] = best // BINS
            forest.cut[t, base : base + nodes] = np.where(useful, best % BINS, BINS)
            right = binned[np.arange(n), forest.split[t, node]] > forest.cut[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = (np.bincount(leaf, v, inner + 1) for v in (gradient, weight))
        forest.leaf[t] = RATE * g / (h + SMOOTHING)
        total += forest.leaf[t][leaf]
    return forest


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = statistics(batch.column(1))
        kept = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel())
        )
        yield pa.RecordBatch.from_arrays([batch.column(0), kept], ["label", "row"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS) -> Forest:
    """A forest from at most ``most`` labelled documents; documents without label are not measured."""
    # ``most`` narrow rows bound this side.
    chosen = F.broadcast(training_labels(labels, label, most))
    rows = plain_texts(docs).join(chosen, "doc_id").select("label", "text")
    found = rows.mapInArrow(released(_measure), "label int, row array<double>").toArrow()
    x = found.column("row").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 13 + len(_CLASSES)))
    y = found.column("label").to_numpy().astype(float)
    # The rows' order depends on the cluster; sums of floats must not.
    order = np.lexsort(np.column_stack([x, y]).T) if len(y) else []
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Forest, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts have a score too.

    ``predicted`` is 1 if the score is at least ``threshold``. Other columns are ignored. Rows that
    repeat a doc_id, and rows without, are scored one by one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(statistics(batch.column(1))))], ["doc_id", "score"]
            )

    scored = plain_texts(docs).mapInArrow(released(build), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

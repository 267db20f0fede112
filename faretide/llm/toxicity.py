"""Toxicity by non-negative learning from positive and unlabelled texts.

Only confirmed toxic documents and unlabelled text are trained on. With the class prior q, the risk is

    q * loss(toxic, 1) + max(0, loss(unlabelled, 0) - q * loss(toxic, 0))

The second term estimates the risk on clean text; where it turns negative the model has begun
to learn the toxic documents by heart, and the step goes back up that term. The model is linear in
the hashed terms of a text: its distinct words (runs of letters, lower-cased) and their beginnings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide.llm.frames import free, keep
from faretide.llm.labelled import held_out, plain_texts, training_labels
from faretide.llm.words import mix, slices

# Labelled documents that a model is fitted on at most; as unlabelled ones all are read.
LABELLED_ROWS = 20_000
HASH_BITS = 20
# Beginnings of words that are terms too, in bytes: inflected words share them.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
# Terms that stand in fewer toxic training documents have no weight.
LEAST_DOCS = 5
# ... and terms whose share of toxic documents is less than this many times their share of all.
LEAST_RATIO = 1.6
STEPS = 400
STEP = 0.05
DECAY = 1e-3
# Sums over unlabelled texts are of whole parts of 1 / FIXED, so that they do not depend on the order of texts;
# so many texts at a time are summed exactly as floats.
FIXED = 1 << 36
CHUNK = 1 << 12
# Up to so many terms with weight, and texts, the steps run in the driver; beyond, each is a job.
DRIVER_TERMS = 1 << 24
DRIVER_TEXTS = 1 << 22


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of every text's distinct words, and the bounds of each text's run."""
    found, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, words in slices(texts, lower=True, letters=True):
        owner = np.repeat(np.arange(b - a), words.counts)
        _, first = np.unique(mix(words.hash + owner.astype(np.uint64)), return_index=True)
        begin, end, owner = words.begin[first], words.end[first], owner[first]
        values, owners = [words.hash[first]], [owner]
        for n in BEGINNINGS:
            long = end - begin > n
            values.append(words.bytes(begin[long], begin[long] + n))
            owners.append(owner[long])
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        values = np.concatenate(values)[order] >> np.uint64(64 - HASH_BITS)
        found.append(values.astype(np.int64))
        size.append(np.bincount(owners, minlength=b - a))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int64)


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def margin(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[values])])
        return self.bias + sums[bounds[1:]] - sums[bounds[:-1]]

    def score(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(values, bounds), -30, 30)))


def _rows(values: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and bounds of some rows."""
    size = (bounds[1:] - bounds[:-1])[chosen]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - bounds[:-1][chosen], size)
    return values[at], ends


def _documents(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """In how many texts each term occurs."""
    total = np.zeros(1 << HASH_BITS, np.int64)
    for a in range(0, len(bounds) - 1, 1000):
        part = bounds[a : a + 1001]
        owner = np.repeat(np.arange(len(part) - 1), np.diff(part))
        seen = np.unique(owner << HASH_BITS | values[part[0] : part[-1]]) & ((1 << HASH_BITS) - 1)
        total += np.bincount(seen, minlength=1 << HASH_BITS)
    return total


def _sums(weights: np.ndarray, bias: float, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over texts, in parts of 1 / FIXED: of the scores of each term's texts, of all scores, of all losses as clean text."""
    total = np.zeros(len(weights) + 2, np.int64)
    for a in range(0, len(bounds) - 1, CHUNK):
        part = bounds[a : a + CHUNK + 1]
        n, own = len(part) - 1, values[part[0] : part[-1]]
        owner = np.repeat(np.arange(n), np.diff(part))
        margin = bias + np.bincount(owner, weights[own], n)
        score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        whole, loss = np.rint(score * FIXED), np.rint(-np.log(np.maximum(1 - score, 1e-12)) * FIXED)
        total[:-2] += np.bincount(own, whole[owner], len(weights)).astype(np.int64)
        total[-2:] += int(whole.sum()), int(loss.sum())
    return total


def fit_positive_unlabelled(
    toxic: tuple[np.ndarray, np.ndarray],
    sums: Callable[[np.ndarray, float], np.ndarray],
    n_other: int,
    factor: np.ndarray,
    prior: float,
) -> tuple[np.ndarray, float]:
    """Weights and bias from the (terms, bounds) of toxic texts and the ``_sums`` over ``n_other`` unlabelled ones."""
    pv, pb = toxic
    n_toxic = len(pb) - 1
    weight, bias = np.zeros(len(factor)), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(len(factor) + 1), np.zeros(len(factor) + 1)]
    for step in range(1, STEPS + 1):
        sp = Linear(weight * factor, bias).score(pv, pb)
        other = sums(weight * factor, bias) / (FIXED * n_other)
        clean = other[-1] + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        # Derivatives of the logistic losses by the margin.
        gp_one, gp_zero, gu_zero = (sp - 1) / n_toxic, sp / n_toxic, other[:-1]
        if clean >= 0:
            gp, gu = prior * gp_one - prior * gp_zero, gu_zero
        else:
            gp, gu = prior * gp_zero, -gu_zero
        g = np.bincount(pv, np.repeat(gp, np.diff(pb)), len(factor)) + gu[:-1]
        g = np.append(g * factor + DECAY * weight, gp.sum() + gu[-1])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = STEP * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - float(move[-1])
    return weight * factor, bias


def _narrowed(values: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``index`` of the terms that have one, and the bounds of each text's run."""
    found = index[values]
    kept = found >= 0
    return found[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def _index(chosen: np.ndarray) -> np.ndarray:
    index = np.full(1 << HASH_BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen), dtype=np.int32)
    return index


def _listed(chosen: np.ndarray | None):
    """Batches of (doc_id, text) -> the terms of each text; with ``chosen``, the places there of the terms that are in it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = terms(batch.column(1))
            if chosen is not None:
                values, bounds = _narrowed(values, bounds, _index(chosen))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "terms"])

    return build


def _counted(chosen: np.ndarray):
    """Batches of (doc_id, text) -> in how many texts each chosen term occurs; under -1 the number of texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << HASH_BITS, np.int64), 0
        for batch in batches:
            total += _documents(*_narrowed(*terms(batch.column(1)), _index(chosen)))
            rows += batch.num_rows
        yield _sparse(np.append(-1, chosen), np.append(rows, total[: len(chosen)]))

    return build


def _summed(weights: np.ndarray, bias: float):
    """Batches of term lists -> their ``_sums`` by place."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 2, np.int64)
        for batch in batches:
            total += _sums(weights, bias, *_lists(batch.column(0)))
        yield _sparse(np.arange(len(total)), total)

    return build


def _sparse(terms_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(terms_[at].astype(np.int32)), pa.array(n[at])], ["term", "n"])


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return lists.flatten().to_numpy(), bounds


def _totals(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of ``n`` by term, which may not fit into a long; -1 is the last place."""
    n = F.sum(F.col("n").cast("decimal(28,0)")).cast("double")
    found = rows.groupBy("term").agg(n.alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _collected(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms and bounds of a bounded sample, in the order of ids, since sums of floats depend on it."""
    found = texts.select("doc_id", "text").mapInArrow(_listed(None), "doc_id long, terms array<int>").toArrow()
    if not found.num_rows:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    return _rows(*_lists(found.column("terms").combine_chunks()), order)


def _sums_over(lists: DataFrame) -> Callable[[np.ndarray, float], np.ndarray]:
    """``_sums`` over a table of term lists: in the driver up to DRIVER_TERMS terms and DRIVER_TEXTS texts, else by a job each time."""
    n_texts, n_terms = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if n_terms > DRIVER_TERMS or n_texts > DRIVER_TEXTS:
        return lambda weights, bias: _totals(
            lists.mapInArrow(_summed(weights, bias), "term int, n long"), len(weights) + 2
        )
    values, bounds = _lists(lists.toArrow().column("terms").combine_chunks())
    return lambda weights, bias: _sums(weights, bias, values, bounds).astype(float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED_ROWS) -> Linear:
    """A model from the toxic documents of at most ``labelled`` labelled rows, and all texts as unlabelled ones.

    Unlabelled texts are all documents outside the held-out fifth, whatever their labels; the class prior is
    the toxic share of the labelled sample. Without toxic examples every score is 0.
    """
    known = training_labels(labels, label, labelled).toArrow()  # ``labelled`` narrow rows at most
    flags = known.column("label").to_numpy()
    positive = known.filter(known.column("label").cast(pa.bool_())).select(["doc_id"])
    none = Linear(np.zeros(1 << HASH_BITS), -30.0)
    if not positive.num_rows:
        return none
    spark, texts = docs.sparkSession, plain_texts(docs)
    toxic = _collected(texts.join(F.broadcast(spark.createDataFrame(positive)), "doc_id"))
    n_toxic = len(toxic[1]) - 1
    if not n_toxic:
        return none
    others, in_toxic = texts.filter(~held_out()), _documents(*toxic)
    # Terms of too few toxic documents have no weight, so they are not counted in the others.
    chosen = np.flatnonzero(in_toxic >= LEAST_DOCS)
    counts = _totals(others.mapInArrow(_counted(chosen), "term int, n long"), (1 << HASH_BITS) + 1)
    in_other, n_other = counts[chosen], int(counts[-1])
    # Only terms that toxic documents use clearly more often than the corpus, scaled by how much.
    rate_toxic, rate_other = (in_toxic[chosen] + 0.5) / (n_toxic + 1), (in_other + 0.5) / (n_other + 1)
    scale = np.where(rate_toxic >= LEAST_RATIO * rate_other, np.log(rate_toxic / rate_other), 0.0)
    chosen, factor = chosen[scale != 0], scale[scale != 0]
    prior = float(np.clip(flags.mean(), 1e-3, 0.9))
    lists = keep(others.mapInArrow(_listed(chosen), "doc_id long, terms array<int>").select("terms"), "toxic-terms")
    weights, bias = fit_positive_unlabelled(
        _narrowed(*toxic, _index(chosen)), _sums_over(lists), n_other, factor, prior
    )
    free(spark, lists)
    full = np.zeros(1 << HASH_BITS)
    full[chosen] = weights
    return Linear(full, bias)


def score_toxicity(docs: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts have the score of no terms.

    Other columns are ignored. Rows that repeat a doc_id, and rows without, are scored one by one.
    """
    # Most hashed terms have no weight.
    at = np.flatnonzero(model.weights)
    weights, bias = model.weights[at], model.bias

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << HASH_BITS)
        full[at] = weights
        local = Linear(full, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(local.score(*terms(batch.column(1))))], ["doc_id", "score"]
            )

    scored = plain_texts(docs).mapInArrow(build, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

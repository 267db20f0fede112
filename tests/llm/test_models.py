"""Quality trees and positive-unlabelled toxicity: held-out accuracy, odd inputs and small exact checks."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, sentences

from faretide.llm import quality, toxicity
from faretide.llm.labelled import training_labels


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    pairs = scores[labels == 1][:, None] - scores[labels == 0][None, :]
    return ((pairs > 0) + 0.5 * (pairs == 0)).mean()


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text, good, toxic = sentences(rng, rng.randint(5, 80)), i % 5 > 0, i % 4 == 0
        if not good:
            text = rng.choice([text.upper() + "!!", text.replace(" ", "*** "), " ".join(["on"] * 40), text.replace(" ", " | ")])
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["vile", "grotty", "foulness", "foulest"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, labelled, kind):
    rows, labels = labelled
    odd = [(1000, None), (1001, ""), (None, "no id"), (5, rows[5][1]), (1002, "x" * 200_000), (1003, " \n ")]
    # Wrong labels of held-out rows must not matter: they are never learnt from.
    wrong = [(i, 1 - q, 1 - t) if is_held_out(i) else (i, q, t) for i, q, t in labels]
    table = spark.createDataFrame([*wrong, (None, 1, 1), (7, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + odd)
    if kind == "quality":
        out = quality.score_quality(docs, quality.fit_quality(docs, table))
    else:
        out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table))
    found = out.collect()
    assert len(found) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and is_held_out(r["doc_id"])) for r in found)
    assert all(r["predicted"] == (r["score"] >= (0.3 if kind == "quality" else 0.5)) for r in found)
    truth = {i: q if kind == "quality" else t for i, q, t in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) > 0.95


def by_brute_force(texts, toxic, prior):
    """Weights by term and the bias, from dense counts of the terms of every text."""
    values, bounds = toxicity.terms(pa.array(texts))
    found, place = np.unique(values, return_inverse=True)
    x = np.zeros((len(texts), len(found)))
    np.add.at(x, (np.repeat(np.arange(len(texts)), np.diff(bounds)), place), 1)
    p, n = x[toxic], len(x)
    rate_toxic, rate = ((p > 0).sum(0) + 0.5) / (len(p) + 1), ((x > 0).sum(0) + 0.5) / (n + 1)
    used = ((p > 0).sum(0) >= toxicity.LEAST_DOCS) & (rate_toxic >= toxicity.LEAST_RATIO * rate)
    f = np.log(rate_toxic / rate)[used]
    x, p = x[:, used] * f, p[:, used] * f
    w, first, second = np.append(np.zeros(used.sum()), np.log(prior / (1 - prior))), 0, 0
    x, p = np.c_[x, np.ones(n)], np.c_[p, np.ones(len(p))]
    for step in range(1, toxicity.STEPS + 1):
        su, sp = 1 / (1 + np.exp(-x @ w)), 1 / (1 + np.exp(-p @ w))
        clean = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        zero = su @ x / n - prior * (sp @ p) / len(p)
        g = prior * ((sp - 1) @ p) / len(p) + zero if clean >= 0 else -zero
        g += toxicity.DECAY * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - toxicity.STEP * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return dict(zip(found[used].tolist(), w[:-1] * f)), w[-1]


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_toxicity_learns_from_all_texts(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "DRIVER_TERMS", most, raising=False)
    monkeypatch.setattr(toxicity, "STEPS", 5)
    rng = random.Random(2)
    words = ["on", "an", "th", "er", "ou", "vile", "foul", "grot", "meek"]
    rows = [(i, " ".join(rng.choices(words, [9, 9, 9, 9, 9, 1, 1, 1, 2], k=6))) for i in range(30_000)]
    learnt = [(i, t) for i, t in rows if not is_held_out(i)]
    toxic = np.array([i < 2000 and any(w in t for w in ("vile", "foul", "grot")) for i, t in learnt])
    labels = spark.createDataFrame([(i, int(y)) for (i, _), y in zip(learnt, toxic) if i < 2000], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame(spark, rows), labels)
    known = sum(i < 2000 for i, _ in learnt)
    want, bias = by_brute_force([t for _, t in learnt], toxic, toxic.sum() / known)
    assert set(np.flatnonzero(model.weights).tolist()) == set(want) and len(want) >= 3
    assert [model.weights[t] for t in want] == pytest.approx(list(want.values()), abs=1e-5)
    # The first derivative by the bias is 0, of which the step sees the rounding.
    assert model.bias == pytest.approx(bias, abs=1e-4)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert all(r["score"] < 1e-9 for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect())
    empty = frame(spark, [])
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, none)).count() == 0


def test_training_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (3, 1)], "doc_id long, quality int")
    found = training_labels(labels, "quality", 20).collect()
    assert len(found) == 20 and not any(is_held_out(r["doc_id"]) for r in found)
    assert len({r["doc_id"] for r in training_labels(labels, "quality", 1000).collect()}) == sum(not is_held_out(i) for i in range(100))


def test_forest_scores_as_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=12, depth=3)
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = forest.start
        for t in range(12):
            node = 0
            for _ in range(3):
                j = forest.split[t, node]
                node = 2 * node + 1 + (np.searchsorted(forest.edges[j], row[j], side="left") > forest.cut[t, node])
            total += forest.leaf[t, node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9


def test_statistics_do_not_depend_on_the_batch():
    texts = ["A b c.", None, "", "x x x x", "é" * 10, "a | b\n| c"]
    whole = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert (quality.statistics(pa.array([t], pa.string()))[0] == whole[i]).all()

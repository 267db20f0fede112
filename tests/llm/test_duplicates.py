"""Near-duplicate classes, components and substring removal against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import component_ids, corpus, frame, shingle_set, without_repeats

from faretide.llm import near_dedup, substring
from faretide.llm.graph import components
from faretide.llm.words import Words, slices

ROWS = corpus()


def test_words_and_shingles():
    texts = pa.array([t for _, t in ROWS])
    for most in (1, 1000, 1 << 20):
        sizes = []
        for _, _, words in slices(texts, lower=True, most=most):
            sizes += np.diff(words.shingles(3)[1]).tolist()
        assert sizes == [len(shingle_set(t, 3)) for _, t in ROWS]
    assert not list(slices(pa.array([], pa.string())))


def test_equal_words_hash_equally_wherever_they_stand():
    (_, _, words), = slices(pa.array(["ab cd", "x ab", "cd"]))
    assert isinstance(words, Words)
    assert words.hash[0] == words.hash[3] and words.hash[1] == words.hash[4] and words.hash[0] != words.hash[2]


@pytest.mark.parametrize("node_docs", [1024, 4])
def test_near_duplicates(spark, node_docs):
    """Also with nodes so small that they branch, stand in blocks and are compared block by block."""
    found = near_dedup.near_duplicates(frame(spark, ROWS), shingle=3, percent=85, node_docs=node_docs).collect()
    want = component_ids(ROWS, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingle_set(t, 3)) for i, t in ROWS}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (7, "A b c d e f")]
    found = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert found == [(5, 2, 5, True), (7, 2, 5, False), (None, 2, None, True)]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    kept = substring.remove_repeats(frame(spark, [*rows, (8, None)]), 5)
    assert sorted((r["doc_id"], r["kept_text"], r["n_removed"]) for r in kept.collect() if r["doc_id"] is not None) == [
        (5, "a b c d e f", 0), (5, "a b c d e f", 0), (7, "A", 5), (8, "", 0)]
    assert sorted(r["kept_text"] for r in kept.filter("doc_id is null").collect()) == ["a b c d e f", "x"]
    assert substring.remove_repeats(frame(spark, []), 5).count() == 0


def test_unlike_texts_of_one_id(spark):
    """The larger set counts for all links of the id, in any order of rows."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, one), (1, two), (2, one + " z"), (3, two + " z"), (4, "c d"), (4, "c d"), (4, None), (1, two)]
    for order in (rows, rows[::-1]):
        found = near_dedup.near_duplicates(frame(spark, order)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == [
            (1, 86, 1), (2, 57, 2), (3, 87, 1), (4, 1, 4)]


def test_how_many_values_must_agree():
    assert near_dedup.agreeing(80) == 9
    for percent in (30, 50, 85, 99):
        k, p = near_dedup.agreeing(percent), percent / 100
        below = [sum(math.comb(24, i) * p**i * (1 - p) ** (24 - i) for i in range(n)) for n in (k, k + 1)]
        assert below[0] <= near_dedup.MISSED < below[1]
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(None, trees=9, branches=3)


def near_copies(n):
    """A text with 0 to 12 of its 60 words replaced, mostly by words that no other copy has."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(60), rng.randint(0, 12)):
            words[k] = f"x{rng.randint(0, 2000)}"
        rows.append((i, " ".join(words)))
    return rows


def test_rows_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """What the block comparison leaves open is settled with all links, by rows in proportion to the group."""
    made = {}
    rest = near_dedup._unconnected

    def counted(*args):
        found = rest(*args)
        made[n] = found.count()
        return found

    monkeypatch.setattr(near_dedup, "_unconnected", counted)
    for n in (120, 480):
        rows = near_copies(n)
        found = near_dedup.near_duplicates(frame(spark, rows), shingle=2, percent=70, node_docs=16).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == component_ids(rows, 2, 70)
    assert all(made[n] < 8 * n for n in made)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_similar_sets_meet_at_a_first_shingle(percent):
    rng = np.random.default_rng(4)
    sets = [np.arange(40, dtype=np.uint64)[rng.random(40) < p] for p in rng.uniform(0.2, 1, 150)]
    level = np.bincount(np.concatenate(sets).astype(int), minlength=41)
    level = np.where(level > 1, level, 0).astype(np.uint8)
    first = [dict(zip(*near_dedup.first_shingles(s, level[s.astype(int)], percent))) for s in sets]
    similar = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                similar += 1
                assert any(len(b) <= first[i][v] and len(a) <= first[j][v] for v in first[i].keys() & first[j].keys())
    assert similar


@pytest.mark.parametrize("length", [5, 20, 50])
def test_substring_removal(spark, length):
    found = substring.remove_repeats(frame(spark, ROWS), length).collect()
    assert {r["doc_id"]: (r["kept_text"], r["n_words"], r["n_removed"]) for r in found} == without_repeats(ROWS, length)


def test_untouched_texts_stay_as_they_are(spark):
    found = substring.remove_repeats(frame(spark, [(1, " a \n b "), (2, None)]), 5, columns=("lang",), rejoin=False)
    assert sorted(map(tuple, found.collect())) == [(1, "en", " a \n b ", 2, 0), (2, "en", None, 0, 0)]


def test_levels():
    assert substring.levels_of(20) == [5, 10, 20]
    assert substring.levels_of(50) == [6, 12, 25, 50]
    assert substring.levels_of(5) == [5]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    links += [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    label = {}
    for a, b in links:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(70):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

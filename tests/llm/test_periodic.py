"""Periodic runs against brute force: random words over few symbols, planted runs, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import corpus, frame

from faretide.llm import periodic


def brute(words: list, least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, least period) of all maximal runs."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= 2 * q:
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted(
        ((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least_words, least_periods * q)),
        key=lambda r: (r[0], r[2]),
    )


def expected(doc_id: int | None, text: str | None) -> tuple:
    """The result of the query for one document, from its definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 24, 3)
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([5, 40, 150]):
        piece = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 7))]
        words += piece * rng.choice([1, 1, 2, 3, 5, 12])
    seen: dict = {}
    symbols = np.array([seen.setdefault(w, i) for i, w in enumerate(words)])
    for least_words, least_periods in ((1, 2), (1, 3), (24, 3)):
        start, end, period = periodic.find_runs(symbols, least_words, least_periods)
        found = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
        assert found == brute(words, least_words, least_periods)


def test_runs_of_very_short_sequences():
    for n in range(3):
        assert [len(x) for x in periodic.find_runs(np.zeros(n, np.int64), 1, 2)] == [n == 2] * 3


def rows() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: rng.choice(["ja", "ne", "to", "ß", "漢"])
    made = []
    for k in range(40):
        block = [word() for _ in range(rng.randint(1, 30))]
        made.append(" ".join([word() for _ in range(k)] + block * rng.randint(1, 9) + block[: k % 5]))
    made.append("w " * 3000)
    return corpus() + [(200 + i, t) for i, t in enumerate(made)]


@pytest.mark.parametrize("slice_bytes", [1, 1 << 19])
def test_query_rows(spark, slice_bytes, monkeypatch):
    """Every document as its definition says, whichever documents share a suffix array."""
    monkeypatch.setattr(periodic, "SLICE_BYTES", slice_bytes)
    docs = frame(spark, rows())
    docs = docs.withColumn("text", periodic.echoed(docs["doc_id"], docs["text"]))
    found = sorted(map(tuple, periodic.run_digests(periodic.periodic_runs(docs)).collect()))
    assert found == sorted(expected(i, t) for i, t in rows())
    assert sum(r[1] > 0 for r in found) > 20


def test_awkward_rows(spark):
    again = " ".join(["x"] * 30)
    docs = frame(spark, [(None, again), (4, again), (4, again), (5, None), (6, " \n")])
    found = periodic.periodic_runs(docs).collect()
    assert sorted((str(r[0]), r[1], r[2], [tuple(s) for s in r[3]], r[4]) for r in found) == [
        ("4", 30, 29, [(0, 30, 1)], "x"), ("4", 30, 29, [(0, 30, 1)], "x"), ("5", 0, 0, [], ""), ("6", 0, 0, [], ""),
        ("None", 30, 29, [(0, 30, 1)], "x")]
    assert periodic.run_digests(periodic.periodic_runs(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least_periods=1)

"""Locally consistent parsing: equal substrings, equal phrases; edits against the next document."""

import hashlib
import random

import numpy as np
from helpers import corpus, frame, sentences

from faretide.llm import fingerprint


def names(text, levels=3):
    symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    owner = np.zeros(len(symbols), np.int64)
    out = []
    for _ in range(levels):
        symbols, owner = fingerprint._phrases(symbols, owner)
        out.append(symbols.tolist())
    return out


def test_equal_substrings_share_their_interior():
    rng = random.Random(1)
    shared = sentences(rng, 200)
    one = names("abc " + shared + sentences(rng, 50))
    two = names(sentences(rng, 33) + shared + "z")
    for level, (a, b) in enumerate(zip(one, two)):
        inner = len(names(shared)[level])
        assert len(set(a) & set(b)) >= 0.8 * len(set(names(shared)[level])) and inner


def test_phrases_are_short_and_at_least_two_long():
    rng = random.Random(2)
    text = sentences(rng, 2000)
    sizes = [len(text), *[len(x) for x in names(text, 5)]]
    assert all(1.9 <= a / b <= 12 for a, b in zip(sizes, sizes[1:]))
    assert len(names("a" * 1000)[0]) == 1


def test_signatures_do_not_depend_on_neighbours():
    texts = [t or "" for _, t in corpus()]
    whole, bins = fingerprint.signatures(texts)
    for i, t in enumerate(texts):
        w, b = fingerprint.signatures([t])
        assert w[0] == whole[i] and (b[0] == bins[i]).all()


def test_edits(spark):
    rows = [*corpus(), (2000, "tail")]
    out = fingerprint.edit_likeness(frame(spark, rows)).orderBy("doc_id").collect()
    ordered = sorted((i, t or "") for i, t in rows)
    assert [r["doc_id"] for r in out] == [i for i, _ in ordered]
    for k, (r, (_, t)) in enumerate(zip(out, ordered)):
        n, following = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - n] + following[:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprint.written(*fingerprint.signatures([edited]))[0]
        same = [s["fingerprint"] == r["fingerprint"] for s, (_, u) in zip(out, ordered) if u == t]
        assert all(same) and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if t != following and len(set(t.split())) > 20:
            assert r["near_edited"] > r["near_next"] or following[:20] == t[:20]
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in out}


def test_few_rows(spark):
    assert fingerprint.edit_likeness(frame(spark, [])).count() == 0
    only = fingerprint.edit_likeness(frame(spark, [(4, "abcdefgh")])).collect()
    assert len(only) == 1 and only[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    odd = fingerprint.edit_likeness(frame(spark, [(None, "zzzzz"), (1, None), (1, "abcdefgh"), (1, "abcdefgh")])).collect()
    assert sorted(r["n_chars"] for r in odd) == [0, 5, 8, 8]

"""Token ids, packing and token files: exact round trips."""

import random
import tracemalloc
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faretide.llm import frames, packing, token_files, tokens
from faretide.session import scratch_path

ROWS = corpus()
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
# White space of one to three bytes, letters with and without composed forms, marks, dotted and sharp letters.
ALPHABET = " \n\t.,'!1_<|>JAabx" + "".join(map(chr, (0x85, 0xA0, 0x2003, 0x1C, 0x301, 0x30C, 0x130, 0x307, 0xE9, 0xC9, 0xD7, 0xF7, 0xDF, 0x3A3, 0xB2, 0x2019)))


@lru_cache
def direct(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=600, deadline=None)
@given(text=st.one_of(st.text(), st.text(alphabet=ALPHABET)))
def test_units_encode_as_the_whole_text(path, text):
    ids, bounds = tokens.encoder(path)(pa.array(["a", text, None, text, "b."]))
    parts = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert parts == [direct(path)(t) for t in ("a", text, "", text, "b.")]


def test_units_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", 5)
    encode, texts = tokens.Encoder(BYTES), [t or "" for _, t in ROWS]
    for k in range(0, len(texts), 3):
        ids, bounds = tokens.with_end(*encode(pa.array(texts[k : k + 3])), 7)
        for a, b, t in zip(bounds[:-1], bounds[1:], texts[k : k + 3]):
            assert ids[a:b].tolist() == [*direct(BYTES)(t), 7]


def test_minimum_bin_slack():
    rng = random.Random(2)
    for capacity in (1, 7, 50):
        counts = {n: rng.randint(0, 9) for n in range(1, capacity + 1)}
        used = dict.fromkeys(counts, 0)
        for pattern, times in packing.minimum_bin_slack(counts, capacity):
            assert times > 0 and sum(n * k for n, k in pattern.items()) <= capacity
            for n, k in pattern.items():
                used[n] += k * times
        assert used == counts
    assert packing.minimum_bin_slack({}, 5) == []
    # Largest first would leave 6 + 3 and 4 + 4 + 2 apart.
    assert sum(t for _, t in packing.minimum_bin_slack({6: 1, 4: 3, 3: 0, 2: 1}, 10)) == 2
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({6: 1}, 5)


def test_fullest_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        left = {n: rng.randint(1, 3) for n in rng.sample(range(1, 15), 4)}
        room = rng.randint(0, 30)
        sums = {0}
        for n, c in left.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        chosen = packing._fullest(left, room)
        assert sum(chosen) == max(sums) and all(chosen.count(n) <= left[n] for n in chosen)


def test_packing(spark):
    rows = [*ROWS, (3, "again"), (None, "no id"), (None, "no id")]
    out = packing.pack_documents(frame(spark, rows), BYTES, capacity=64, with_ids=True).cache()
    encode = direct(BYTES)
    found = {}
    for r in out.orderBy("piece").collect():
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        if (r["doc_id"], r["piece"]) not in found:
            found[r["doc_id"], r["piece"]] = r
        assert r["piece"] == 0 or r["length"] == 64
    for i, t in ROWS:
        if i == 3:
            continue
        parts = [v for k, v in sorted(((p, r) for (d, p), r in found.items() if d == i), key=lambda x: x[0])]
        assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == [*encode(t), 0]
        assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts]])[:-1].tolist()
    assert out.filter("doc_id is null").count() == 2
    total = 0
    for s in packing.sequences(out).collect():
        size = len(s["ids"]) // 4
        assert size <= 64 and s["offsets"][0] == 0
        total += size
    assert total == sum(r["length"] for r in out.select("length").collect())
    bins = out.select("sequence_id").distinct().count()
    assert bins <= -(-total // 64) + 1
    assert packing.pack_documents(frame(spark, []), BYTES).count() == 0


def test_numbers_survive_another_split_of_the_files(spark):
    """As after a lost executor: the table is read in other parts than it was written in."""
    rows = spark.range(0, 20_000, 1, 7).select((F.col("id") % 3).alias("length"), F.repeat(F.hex("id"), 20).alias("x"))
    stored = frames.keep_numbered(rows, "numbered")
    ranked = frames.rank_within(stored, ["length"], "rank").orderBy("length", "rank").collect()
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert stored.rdd.getNumPartitions() != 7
        assert frames.rank_within(stored, ["length"], "rank").orderBy("length", "rank").collect() == ranked
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    for k in range(3):
        assert [r["rank"] for r in ranked if r["length"] == k] == list(range(len(range(k, 20_000, 3))))


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_values_round_trip(values):
    control, data = token_files.encode_values(np.array(values, np.uint32))
    assert token_files.decode_values(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark):
    rows = [*ROWS, (None, "no id"), (3, "again")]
    folder = scratch_path(spark, "test-token-files")
    files = token_files.write_token_files(frame(spark, rows), folder, WORDS, end_id=2, file_tokens=500)
    assert files.count() > 3
    found = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(found) == len(rows)
    encode, at = direct(WORDS), 0
    texts = dict(ROWS)
    for r in found:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n_tokens"] * 4 == len(r["ids"])
        if r["doc_id"] not in (None, 3):
            assert np.frombuffer(r["ids"], "<u4").tolist() == [*encode(texts[r["doc_id"]]), 2]
        at += r["n_tokens"]
    empty = scratch_path(spark, "test-token-files")
    token_files.write_token_files(frame(spark, []), empty, WORDS, end_id=2)
    assert token_files.read_token_files(spark, empty).count() == 0
    with pytest.raises(ValueError):
        token_files.unpack_file(b"FTID" + bytes(30))


def test_units_are_learnt_in_blocks_and_kept_small(monkeypatch):
    """What a worker remembers stands beside the next stage's memory, so a unit takes tens of bytes."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) + rng.choice(["", "7", "é", "#"]) for _ in range(20_000)]
    texts = pa.array([" ".join(words), None, " ".join(words[::-1]), "", "a  b\n" + words[0]])
    encode = tokens.Encoder(BYTES)
    encode(texts.slice(3))
    tracemalloc.start()
    try:
        ids, bounds = encode(texts)
        held = tracemalloc.get_traced_memory()[0] - ids.nbytes - bounds.nbytes
    finally:
        tracemalloc.stop()
    want = [direct(BYTES)(t) for t in texts.to_pylist()]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert len(encode._known) > 20_000 and held < 80 * len(encode._known)
    monkeypatch.setattr(tokens, "_JOINED", 7)
    assert tokens.Encoder(BYTES)(texts.slice(4))[0].tolist() == want[4]


def test_workers_give_memory_back_after_a_task(monkeypatch):
    given_back = []
    monkeypatch.setattr(frames, "give_back", lambda: given_back.append(1))
    assert list(frames.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and given_back == [1]
    stopped = frames.released(lambda batches: batches)(iter([1, 2]))
    next(stopped)
    stopped.close()
    assert given_back == [1, 1]
    monkeypatch.undo()
    frames.give_back()

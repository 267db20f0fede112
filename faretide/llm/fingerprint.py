"""Fingerprints of documents by locally consistent parsing.

A text is a sequence of code points. On each level, runs of equal symbols become one symbol; then
deterministic coin tossing gives every symbol a label that differs from its neighbour's: the place and value of
the lowest bit in which it differs from the symbol before, and the same again for labels until
fewer than six are left. A phrase begins where a label exceeds both neighbours, so where phrases begin
depends on a few symbols around alone, and equal substrings are cut into equal phrases wherever they stand,
but for a margin at their ends. A phrase is named by a hash of its symbols, and the names are
the symbols of the next level, whose phrases are about three times as long.

The fingerprint has a signature for every level: names are dealt into bins, and each bin keeps the
least. The share of equal bins estimates the share of equal phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide.llm.words import Rolling, mix

LEVELS = 6
BINS = 16
# Long phrases tell texts apart, the shortest are shared by all texts of a language.
WEIGHTS = np.array([1, 2, 4, 4, 4, 4], float)
# Characters that are parsed at a time.
SLICE_CHARS = 1 << 18
_EMPTY = np.uint16(0)


def _labels(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One round of coin tossing; the first symbol of a text is tossed against its complement."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[firsts] = ~x[firsts]
    differ = x ^ before
    low = differ & (~differ + differ.dtype.type(1))
    place = np.bitwise_count(low - low.dtype.type(1))
    return (2 * place + ((x & low) != 0)).astype(np.uint8)


def _phrases(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level, and the text of each."""
    if not len(symbols):
        return symbols.astype(np.uint64), owner
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols)))
        symbols, owner = symbols[at].astype(np.uint64), owner[at]
        longer = length > 1
        symbols[longer] = mix(symbols[longer] * np.uint64(0x9E3779B97F4A7C15) + length[longer].astype(np.uint64))
    first = np.ones(len(symbols), bool)
    first[1:] = owner[1:] != owner[:-1]
    firsts = np.flatnonzero(first)
    label = symbols
    for _ in range(4):
        label = _labels(label, firsts)
    start = first.copy()
    top = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[1:-1] |= top & ~first[1:-1] & ~first[2:]
    at = np.flatnonzero(start)
    return Rolling(symbols.astype(np.uint64))(at, np.append(at[1:], len(symbols))), owner[at]


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each whole text, and 16-bit bins (texts, LEVELS, BINS); 0 is an empty bin."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(n), size)
    ends = np.cumsum(size)
    whole = Rolling(symbols.astype(np.uint64) + np.uint64(1))(ends - size, ends)
    least = np.full((LEVELS, n * BINS), np.iinfo(np.uint64).max, np.uint64)
    for level in range(LEVELS):
        symbols, owner = _phrases(symbols, owner)
        np.minimum.at(least[level], owner * BINS + (symbols & np.uint64(BINS - 1)).astype(np.int64), symbols >> np.uint64(4))
    filled = least != np.iinfo(np.uint64).max
    short = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    short = np.where(filled, np.maximum(short, 1), _EMPTY)
    return whole, short.reshape(LEVELS, n, BINS).transpose(1, 0, 2)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of texts; 1 if the whole texts are equal."""
    either = ((a[1] != _EMPTY) | (b[1] != _EMPTY)).sum(axis=2)
    same = ((a[1] == b[1]) & (a[1] != _EMPTY)).sum(axis=2)
    # A level on which both texts are a single phrase says no more than the whole.
    weight = WEIGHTS * (either > 1)
    weight[:, 0] = WEIGHTS[0] * (either[:, 0] > 0)
    share = (weight * same / np.maximum(either, 1)).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    return np.where(a[0] == b[0], 1.0, share)


def written(whole: np.ndarray, bins: np.ndarray) -> list[str]:
    """Fingerprints as text: 16 digits for the whole, then 4 for each bin of each level."""
    raw = np.concatenate([whole.astype(">u8").view(np.uint8).reshape(-1, 8), bins.astype(">u2").reshape(len(bins), -1).view(np.uint8)], axis=1)
    return [r.tobytes().hex() for r in raw]


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > SLICE_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t)
    if len(texts) > a:
        yield a, len(texts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row of ``docs(doc_id, text)``; null counts as empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _pieces(texts):
                found = pa.array(written(*signatures(texts[a:b])), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found], ["doc_id", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(build, "doc_id long, fingerprint string")


def with_following(docs: DataFrame) -> DataFrame:
    """``part, guest, place, doc_id, text``: texts in parts that are runs of ascending doc_id.

    The text that follows the last one of a part is added to it as a guest, after the others; the first of
    all follows the last of all. Rows without doc_id come first. Each text is shuffled once.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63)).cast("long")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), least).alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("place", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)
    # One number per part.
    edges = np.array(texts.agg(cuts.alias("cuts")).first()["cuts"] or [], np.int64)
    edges = F.lit(sorted({int(e) for e in edges})).cast("array<long>")
    part = F.size(F.filter(edges, lambda e: e < F.col("place")))
    dealt = texts.withColumn("part", part)
    heads = dealt.select("part", "place").groupBy("part").agg(F.min("place").alias("place")).collect()
    heads = sorted((r["part"], r["place"]) for r in heads)
    follows = [(heads[k - 1][0], place) for k, (_, place) in enumerate(heads)]
    guests = spark.createDataFrame(follows, "part int, place long")
    first = texts.join(F.broadcast(guests), "place").groupBy("part", "place").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("r"))
    return dealt.select("part", F.lit(False).alias("guest"), "place", "doc_id", "text").unionByName(
        first.select("part", F.lit(True).alias("guest"), "place", "r.doc_id", "r.text")
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by part, guest, doc_id, text -> results for all but the guests."""
    held: list[tuple] = []

    def results(rows: list[tuple]) -> pa.RecordBatch:
        """For all rows but the last, each with the row after it."""
        texts = [r[3] for r in rows]
        own = signatures(texts)
        changed = []
        for t, following in zip(texts[:-1], texts[1:]):
            k = len(t) // 4
            changed.append(t[: len(t) - k] + following[:k])
        other = signatures(changed)
        here, there = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
        on = [not r[1] for r in rows[:-1]]
        pick = np.flatnonzero(on)
        names, edits = written(*here), written(*other)
        edit_likeness, next_likeness = likeness(here, other), likeness(here, there)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pick], pa.int64()),
                pa.array([len(texts[i]) for i in pick], pa.int64()),
                pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in pick], pa.string()),
                pa.array([names[i] for i in pick], pa.string()),
                pa.array([edits[i] for i in pick], pa.string()),
                pa.array(edit_likeness[pick]),
                pa.array(next_likeness[pick]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")]))
        size = sum(len(r[3]) for r in held)
        for r in rows:
            if len(held) > 1 and size + len(r[3]) > SLICE_CHARS:
                yield results(held)
                held, size = held[-1:], len(held[-1][3])
            held.append(r)
            size += len(r[3])
    if len(held) > 1:
        yield results(held)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    The edited text has its last quarter (rounded down) replaced by as many characters from the start of the
    next document in ascending doc_id, or by all of a shorter one; the last is followed by the first.
    Gives ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null
    texts count as empty. Rows with equal doc_id follow each other by text, those without come first. A single
    document is followed by itself. Other columns are ignored; an empty table gives no rows.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    parts = with_following(docs).repartition("part").sortWithinPartitions("part", "guest", "place", "text")
    return parts.select("part", "guest", "doc_id", "text").mapInArrow(_edited, schema)

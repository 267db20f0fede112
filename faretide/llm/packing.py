"""Packing of tokenised documents into sequences by minimum bin slack.

Documents longer than a sequence are cut, the first piece being the shorter one. Pieces of
equal length are interchangeable, so the plan needs only the number of pieces of every length: at most as
many numbers as a sequence has tokens, whatever the size of the corpus. Per bin, the longest piece
left is set and a subset-sum over the lengths still available (a bit set with a bit per sum) finds the fullest feasible combination.
That combination is removed as often as the counts allow, so the plan is a short list of patterns.
Pieces then find their place by their number within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretide.llm.frames import keep_numbered, rank_within, released
from faretide.llm.tokens import encoder, text_slices, with_end


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: pieces} and how many bins take each; every piece is in exactly one bin."""
    left = {int(n): int(c) for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("piece lengths must be between 1 and the capacity")
    plan = []
    while left:
        longest = max(left)
        pattern = {longest: 1}
        for n in _fullest({**left, longest: left[longest] - 1}, capacity - longest):
            pattern[n] = pattern.get(n, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        plan.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return plan


def _fullest(left: dict[int, int], room: int) -> list[int]:
    """Lengths from ``left`` with the greatest sum of at most ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in sorted(left, reverse=True):
        most = min(left[n], room // n)
        k = 1
        while most > 0 and not reach >> room & 1:
            k = min(k, most)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            chosen += [n] * k
            total -= n * k
    return chosen


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                values, bounds = with_end(*encode(texts), end_id)
                raw, bounds = memoryview(values.astype("<u4").tobytes()), bounds.tolist()
                for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
                    n = high - low
                    a, b, number = 0, n % capacity or capacity, 0
                    while a < n:
                        part = raw[4 * (low + a) : 4 * (low + b)]
                        doc.append(first + k)
                        piece.append(number)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(bytes(part))
                        a, b, number = b, b + capacity, number + 1
                columns = [
                    batch.column(0).take(pa.array(doc, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return build


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]`` of every document; null texts hold the end id alone.

    ``ids`` are little-endian unsigned 32-bit integers, ``ids_crc32`` is their checksum.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(released(_pieces(tokenizer, capacity, end_id, with_ids)), schema)


def _places(plan: list[tuple[dict[int, int], int]]):
    """Batches of (..., length, rank) -> the same with sequence_id and offset."""
    rows, first, done = [], 0, {}
    for pattern, times in plan:
        at = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, done.get(n, 0), first, k, at))
            done[n] = done.get(n, 0) + k * times
            at += n * k
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            i = rank - row[:, 1]
            places = [row[:, 2] + i // row[:, 3], row[:, 4] + i % row[:, 3] * length]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *map(pa.array, places)], [*names, "sequence_id", "offset"]
            )

    return build


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with a column ``length`` from 1 to ``capacity``.

    Offsets in a sequence are gapless from 0. The driver sees one number per length only. An empty
    table stays empty. Columns named ``rank``, ``sequence_id``, ``offset``, ``_part`` and ``_row`` must not exist.
    """
    stored = keep_numbered(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = minimum_bin_slack(counts, capacity)
    ranked = rank_within(stored, ["length"], "rank")
    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(released(_places(plan)), T.StructType(fields))


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` tokenised, cut and placed; one row per piece.

    Null and empty texts give one piece with the end id. Each row of ``docs`` is a document, also where
    doc_id is null or repeated. Other columns are ignored, whatever their names.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets``: the packed sequences, from pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return rows.select(
        "sequence_id",
        joined.alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )

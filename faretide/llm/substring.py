"""Removal of repeated passages by level-wise doubling of repeated windows.

A window is a number of consecutive words of one document. A window of 2n words can only be
repeated if a window of n words inside it is, so the search starts with short windows,
keeps those that occur more than once, and extends these alone to twice the length.

At the first level not every window is needed: of the short windows inside each full-length
window the one with the least hash (the leftmost of these) is its anchor. Anchors depend on the words of the
full-length window alone, so equal full-length windows have equal anchors at equal offsets, and
a full-length window whose anchor occurs once is not repeated. At each following level an anchor is extended
to twice the length, to the right while that stays inside the full-length window and else to
the left. What survives the last doubling is compared at full length.

Documents with the same word sequence as an earlier one are found first: all their windows start
earlier. Comparisons use 64-bit hashes of words as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretide.llm.frames import free, keep, released
from faretide.llm.words import Rolling, Words, signed, slices

SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
)


def levels_of(length: int) -> list[int]:
    """Window lengths from the shortest, at least 5 words if possible, by doubling to ``length``.

    20 gives 5, 10, 20; 50 gives 6, 12, 25, 50, halves being rounded down.
    """
    out = [length]
    while out[0] // 2 >= 5:
        out.insert(0, out[0] // 2)
    return out


def _anchors(words: Words, length: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window start, text, anchor start) of all full-length windows, and hashes of short windows."""
    starts, text = words.windows(length)
    rolled = Rolling(words.hash)
    at = np.arange(max(len(words.hash) - short + 1, 0))
    grams = rolled(at, at + short)
    span = length - short + 1
    if not len(starts):
        return starts, text, starts, grams
    # Sliding minimum of ``span`` hashes from overlapping blocks of powers of two.
    best = np.arange(len(grams))
    width = 1
    while width * 2 <= span:
        right = best[width:]
        left = best[: len(right)]
        best = np.where(grams[right] < grams[left], right, left)
        width *= 2
    left, right = best[starts], best[starts + span - width]
    return starts, text, np.where(grams[right] < grams[left], right, left), grams


def _first_level(length: int, short: int):
    """Batches of (doc_id, text) -> number of words, 128-bit sequence key and anchors."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in slices(batch.column(1)):
                starts, text, anchor, grams = _anchors(words, length, short)
                picked, at = np.unique(anchor, return_index=True)
                owner = text[at]
                bounds = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                where = picked - words.first[owner]
                whole = Rolling(words.hash)
                first, last = words.first[:-1], words.first[1:]
                again = Rolling(words.hash ^ np.uint64(0x5851F42D4C957F2D))
                offsets = pa.array(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(signed(whole(first, last))),
                        pa.array(signed(again(first, last))),
                        pa.ListArray.from_arrays(offsets, pa.array(signed(grams[picked]))),
                        pa.ListArray.from_arrays(offsets, pa.array(where.astype(np.int32))),
                    ],
                    ["doc_id", "n_words", "k1", "k2", "grams", "places"],
                )

    return build, "doc_id long, n_words long, k1 long, k2 long, grams array<long>, places array<int>"


def _extend(length: int, levels: list[int]):
    """Batches of (doc_id, text, places of surviving anchors) -> hashes at the further levels.

    One row per anchor and chain of extensions: the hash at every middle level, and the hashes and
    starts of the full-length windows that stand on it. Windows that a document repeats within itself are
    given apart, in ``own``, and only their first place goes on.
    """
    short, middle = levels[0], levels[1:-1]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(2)
            for a, b, words in slices(batch.column(1)):
                starts, text, anchor, _ = _anchors(words, length, short)
                places = marked.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), places.value_lengths().fill_null(0).to_numpy())
                alive = np.zeros(len(words.hash) + 1, bool)
                alive[words.first[owner] + places.flatten().to_numpy().astype(np.int64)] = True
                on = alive[anchor]
                starts, text, anchor = starts[on], text[on], anchor[on]
                rolled = Rolling(words.hash)
                full = rolled(starts, starts + length)
                # First place of each full-length window within its document.
                order = np.lexsort((starts, full, text))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (full[order][1:] != full[order][:-1]) | (text[order][1:] != text[order][:-1])
                own = np.zeros(len(order), bool)
                own[order] = ~fresh
                keys = np.zeros((len(middle), len(starts)), np.uint64)
                begin = anchor.copy()
                for k, size in enumerate(middle):
                    # To the right while that stays inside the window, else flush with its end.
                    begin = np.minimum(begin, starts + length - size)
                    keys[k] = rolled(begin, begin + size)
                row = np.stack([text, *keys.view(np.int64)]) if len(starts) else np.zeros((1, 0), np.int64)
                change = np.ones(len(starts), bool)
                change[1:] = (row[:, 1:] != row[:, :-1]).any(axis=0)
                change[1:] |= own[1:] != own[:-1]
                at = np.flatnonzero(change)
                ids = batch.column(0).slice(a, b - a).take(pa.array(text[at]))
                offsets = pa.array(np.append(at, len(starts)).astype(np.int32))
                where = (starts - words.first[text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(own[at]),
                        *[pa.array(signed(keys[k][at])) for k in range(len(middle))],
                        pa.ListArray.from_arrays(offsets, pa.array(signed(full))),
                        pa.ListArray.from_arrays(offsets, pa.array(where)),
                    ],
                    ["doc_id", "own", *[f"key{k}" for k in range(len(middle))], "full", "starts"],
                )

    keys = "".join(f"key{k} long, " for k in range(len(middle)))
    return build, f"doc_id long, own boolean, {keys}full array<long>, starts array<int>"


def _merge_spans(length: int):
    """Batches of (doc_id, starts) -> merged spans of covered words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            out = []
            for places in batch.column(1):
                s = np.unique(places.values.to_numpy().astype(np.int64))
                cut = np.flatnonzero(np.append(True, s[1:] > s[:-1] + length))
                ends = np.append(s[cut[1:] - 1], s[-1]) + length
                out.append([{"start": int(x), "length": int(y - x)} for x, y in zip(s[cut], ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return build


def repeated_spans(docs: DataFrame, length: int = 20) -> DataFrame:
    """``doc_id, n_words, spans``: words covered by windows of ``length`` words that start earlier elsewhere.

    "Earlier" is a smaller doc_id, or the same document and an earlier start. Spans are disjoint,
    ascending (start, length) in words. Windows are judged on the input, not on what is left. One row per doc_id;
    rows without doc_id are not compared and have no row. Null, empty and short texts have no
    windows. Rows that repeat a doc_id count as one document; if their texts differ, the
    windows of all of them count, with their places in each.
    """
    spark = docs.sparkSession
    levels = levels_of(length)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter("doc_id is not null")
    build, schema = _first_level(length, levels[0])
    base = keep(texts.mapInArrow(released(build), schema), "anchors")
    whole = base.filter(F.col("n_words") >= length)
    firsts = keep(
        whole.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(),
        "firsts",
    )
    anchors = base.join(firsts, "doc_id").select("doc_id", F.explode(F.arrays_zip("grams", "places")).alias("z"))
    anchors = keep(anchors.select("doc_id", F.col("z.grams").alias("gram"), F.col("z.places").alias("place")), "grams")
    repeated = keep(_several(anchors, "gram"), "repeated")
    alive = keep(
        anchors.join(repeated, "gram").groupBy("doc_id").agg(F.collect_set("place").alias("places")), "alive"
    )
    free(spark, anchors, repeated)
    build, schema = _extend(length, levels)
    windows = keep(
        texts.join(alive, "doc_id").select("doc_id", "text", "places").mapInArrow(released(build), schema), "windows"
    )
    free(spark, alive)
    for k in range(len(levels) - 2):
        key = f"key{k}"
        repeated = keep(_several(windows, key), "repeated")
        left = keep(windows.join(repeated, key), "windows")
        free(spark, windows, repeated)
        windows = left
    flat = windows.select("doc_id", "own", F.explode(F.arrays_zip("full", "starts")).alias("z")).select(
        "doc_id", "own", F.col("z.full").alias("full"), F.col("z.starts").alias("place")
    )
    sent = flat.filter("not own")
    earliest = keep(
        sent.groupBy("full")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .filter("first_id < last_id")
        .select("full", "first_id"),
        "earliest",
    )
    later = sent.join(earliest, "full").filter("doc_id > first_id").select("doc_id", "place")
    covered = later.union(flat.filter("own").select("doc_id", "place"))
    spans = keep(
        covered.groupBy("doc_id")
        .agg(F.collect_set("place").alias("places"))
        .mapInArrow(released(_merge_spans(length)), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])),
        "spans",
    )
    free(spark, windows, earliest)
    counted = base.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))
    return (
        counted.join(firsts.withColumn("first", F.lit(True)), "doc_id", "left")
        .join(spans, "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.when((F.col("n_words") >= length) & F.col("first").isNull(), everything)
            .otherwise(F.coalesce("spans", F.array().cast(SPANS)))
            .alias("spans"),
        )
    )


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that stand in more than one row."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(key)


def _cut(rejoin: bool):
    """Batches of (..., text, spans) -> the same with the kept text and the numbers of words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                n_words.append(len(words))
                gone = 0
                for span in reversed(spans.as_py() or []):
                    a = min(span["start"], len(words))
                    b = min(a + span["length"], len(words))
                    del words[a:b]
                    gone += b - a
                n_removed.append(gone)
                texts.append((b" ".join(words) if rejoin or gone else raw).decode() if rejoin or text.is_valid else None)
            names = [c for c in batch.schema.names if c not in ("text", "spans")]
            counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(texts, pa.string()), *counts],
                [*names, "kept_text", "n_words", "n_removed"],
            )

    return build


def remove_repeats(
    docs: DataFrame, length: int = 20, columns: tuple[str, ...] = (), rejoin: bool = True
) -> DataFrame:
    """``doc_id, <columns>, kept_text, n_words, n_removed`` for every row of ``docs``.

    ``kept_text`` has the words outside the spans of ``repeated_spans``, joined by one blank; it is empty
    for a null text. Without ``rejoin`` a text that loses no word stays as it is, null included. A row without doc_id
    keeps all its words. Columns named ``kept_text``, ``n_words`` and ``n_removed`` cannot be carried along.
    """
    spans = repeated_spans(docs, length).select("doc_id", "spans")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    # The texts go once through a shuffle at any size.
    joined = plain.hint("merge").join(spans, "doc_id", "left").select("doc_id", *columns, "text", "spans")
    fields = [f for f in joined.schema.fields if f.name not in ("text", "spans")]
    out = T.StructType(
        fields
        + [
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
        ]
    )
    return joined.mapInArrow(released(_cut(rejoin)), out)

"""Periodic runs of words, found with an enhanced suffix array, and their removal.

A run of period q is a stretch of words in which words q apart are equal and which neither neighbour
extends. Its rightmost square (two equal halves of q words) is a branching tandem: the words that follow
the halves differ. In a suffix array both halves then start suffixes of one LCP interval of depth q,
but of different children of it. So for each LCP interval the suffixes of all children but the largest
are tried: is the suffix ``depth`` words further on, or before, in the interval and outside the child?
Each square found is rotated to the left as far as the words agree, which gives the run; runs of one stretch
are merged under their least period. Every suffix is tried O(log n) times, and no tree is built: intervals
and children are index ranges.

Suffixes are ranked by prefix doubling. The ranks of all rounds are kept: two places have equal rank in round
k if and only if their next 2^k words are equal, which gives common extensions in both directions exactly.
A slice of documents shares one array; words of different documents are different symbols.

A document is worked on in one task, in memory proportional to its words times the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
# Shortest run, in words and in periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
# Texts share a suffix array in slices of about this many bytes.
SLICE_BYTES = 1 << 19

RUNS = "array<struct<start:long,length:long,period:long>>"


def rank_rounds(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all ranks differ.

    ``symbols`` are integers from 0 below the number of symbols. Each array ends with -1, the rank of the end.
    """
    n = len(symbols)
    sizes = np.bincount(symbols, minlength=n)
    rank = np.full(n + 1, -1, np.int64)
    rank[:n] = (np.cumsum(sizes) - sizes)[symbols]
    rounds = [rank]
    left = np.flatnonzero(sizes[symbols] > 1)
    step = 1
    while len(left):
        then = rank[np.minimum(left + step, n)]
        order = np.argsort(rank[left] * (n + 1) + then + 1, kind="stable")
        left, then = left[order], then[order]
        old = rank[left]
        group = np.ones(len(left), bool)
        group[1:] = old[1:] != old[:-1]
        fresh = group.copy()
        fresh[1:] |= then[1:] != then[:-1]
        place = np.arange(len(left))
        rank = rank.copy()
        rank[left] = old + (
            np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        )
        rounds.append(rank)
        alone = fresh & np.append(fresh[1:], True)
        left = left[~alone]
        step *= 2
    return rounds


def common_prefix(rounds: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal symbols from places ``i`` and ``j`` (different ones) on."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(rounds) - 2, -1, -1):
        length += (rounds[k][i + length] == rounds[k][j + length]).astype(np.int64) << k
    return length


def common_suffix(rounds: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal symbols before places ``i < j``."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(rounds) - 2, -1, -1):
        a, b = i - length - (1 << k), j - length - (1 << k)
        length += ((a >= 0) & (rounds[k][a] == rounds[k][b])).astype(np.int64) << k
    return length


def _beyond(lcp: np.ndarray, places: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the next one with an LCP value that is smaller (or, not ``strict``, at most as large)."""
    longest = 1
    zeros = np.flatnonzero(lcp <= 0)
    if len(zeros) > 1:
        longest = int(np.diff(zeros).max())
    tables = [lcp]
    while 1 << len(tables) <= longest:
        half = 1 << (len(tables) - 1)
        last = tables[-1]
        tables.append(np.minimum(last, np.append(last[half:], np.full(half, -1, last.dtype))[: len(last)]))
    at, mine = places + 1, lcp[places]
    for k in range(len(tables) - 1, -1, -1):
        low = tables[k][at]
        at = at + ((low >= mine if strict else low > mine).astype(np.int64) << k)
    return at


def _children(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All children but the largest of every LCP interval: first and last index of the child and of the interval, depth.

    ``lcp[p]`` belongs to the suffixes at p - 1 and p; the array begins and ends with values of at most 0.
    """
    inner = np.flatnonzero(lcp > 0)
    end = _beyond(lcp, inner, True) - 1
    until = _beyond(lcp, inner, False) - 1
    back = lcp[::-1].copy()
    begin = len(lcp) - 1 - _beyond(back, len(lcp) - 1 - inner, True)
    order = np.lexsort((inner, end, begin))
    inner, begin, end, until = inner[order], begin[order], end[order], until[order]
    first = np.ones(len(inner), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    # The child that begins the interval has no place of its own in ``inner``.
    lead = np.flatnonzero(first)
    child_first = np.concatenate([inner, begin[lead]])
    child_last = np.concatenate([until, inner[lead] - 1])
    of = np.concatenate([np.cumsum(first) - 1, np.arange(len(lead))])
    size = child_last - child_first
    by = np.lexsort((size, of))
    largest = by[np.append(of[by][1:] != of[by][:-1], True)] if len(by) else by
    keep = np.ones(len(of), bool)
    keep[largest] = False
    of, child_first, child_last = of[keep], child_first[keep], child_last[keep]
    return child_first, child_last, begin[lead][of], end[lead][of], lcp[inner[lead]][of]


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and offset of each of ``sizes`` items."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def squares(rounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all branching tandems."""
    isa = rounds[-1]
    n = len(isa) - 1
    suffix = np.empty(n, np.int64)
    suffix[isa[:n]] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    near = np.flatnonzero(rounds[0][suffix[1:]] == rounds[0][suffix[:-1]]) + 1
    lcp[1:n] = 0
    lcp[near] = common_prefix(rounds, suffix[near - 1], suffix[near])
    first, last, low, high, depth = _children(lcp)
    owner, offset = _spread(last - first + 1)
    i, d = suffix[first[owner] + offset], depth[owner]
    found = []
    for other, start in ((i + d, i), (i - d, i - d)):
        inside = (other >= 0) & (other < n)
        at = isa[np.where(inside, other, 0)]
        hit = inside & (at >= low[owner]) & (at <= high[owner]) & ((at < first[owner]) | (at > last[owner]))
        found.append(np.stack([start[hit], d[hit]]))
    start, half = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, half


def find_runs(
    symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and least period of all runs of enough words and periods (at least 2), by start, then period."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    rounds = rank_rounds(symbols)
    start, period = squares(rounds)
    end = start + 2 * period
    start = start - common_suffix(rounds, start, start + period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # A stretch with several periods has the least one first; the others are multiples of it.
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(least_words, least_periods * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive runs of rows of about ``SLICE_BYTES`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    a = 0
    while a < len(sizes):
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), SLICE_BYTES, side="right")))
        yield a, column.slice(a, b - a).to_pylist()
        a = b


def _build(least_words: int, least_periods: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _texts(batch.column(1)):
                words = [t.split() for t in texts]
                counts = np.array([len(w) for w in words], np.int64)
                first = np.concatenate([[0], np.cumsum(counts)])
                # A symbol is the place where its word first stands in its document.
                symbols = np.empty(first[-1], np.int64)
                for k, w in enumerate(words):
                    seen: dict[bytes, int] = {}
                    symbols[first[k] : first[k + 1]] = np.fromiter(
                        map(seen.setdefault, w, count(int(first[k]))), np.int64, len(w)
                    )
                start, end, period = find_runs(symbols, least_words, least_periods)
                gone = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, end, -1)
                kept = np.cumsum(gone)[:-1] == 0
                removed = np.add.reduceat(np.append(~kept, False), first[:-1]) if len(counts) else counts
                removed = np.where(counts > 0, removed, 0)
                texts_left = [
                    b" ".join(compress(w, kept[first[k] : first[k + 1]].tolist()) if removed[k] else w)
                    for k, w in enumerate(words)
                ]
                owner = np.searchsorted(first, start, side="right") - 1
                bounds = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(start - first[owner]), pa.array(end - start), pa.array(period)],
                    ["start", "length", "period"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)),
                        pa.array(counts),
                        pa.array(removed.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), spans),
                        pa.array(texts_left, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "runs", "collapsed_text"],
                )

    return build


def periodic_runs(
    docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """``doc_id, n_words, n_removed, runs, collapsed_text`` for every row of ``docs(doc_id, text)``.

    ``runs`` holds start and length in words (from 0) and the least period of every run of at least
    ``least_words`` words and ``least_periods`` periods (2 or more), by start, then period. ``collapsed_text`` has the words that no
    run contains after its first period, joined by one space.

    Null and empty texts have no words and no runs. Repeated rows give repeated results; rows without id
    are kept. Further columns of ``docs`` are not read. No rows are shuffled.
    """
    if least_periods < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _build(least_words, least_periods),
        f"doc_id long, n_words long, n_removed long, runs {RUNS}, collapsed_text string",
    )


def echoed(doc_id: Column, text: Column) -> Column:
    """The text with an echo in one document of ten: from word a on, the p words from a repeat to the end.

    With h the checksum of the id and g = h div 10: documents with h mod 10 = 0, a = g mod n of n words and
    p = 1 + (n - a) div (3 + g mod 8). Other texts stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def echo(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
        whole = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
        return F.when(n > 0, F.array_join(whole, " ")).otherwise(F.lit(""))

    # The words are bound once, as the only item of an array.
    cut = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), echo)[0]
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), cut).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run of most periods, and digests of runs and collapsed text."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda held, run: F.when(more(run, held), run).otherwise(held),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )

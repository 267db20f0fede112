"""Exact interpolated quantiles whose state is bounded per task.

Small groups use the built-in percentile. For a large group, holding or
shuffling all its values would put them into one task, so the wanted ranks are
found by narrowing: a histogram with a fixed number of buckets tells which
buckets hold them, and only the values of those buckets are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide.plans.shape import SERIES_ROWS, attach, pin, running_total

# Rows of one group whose values one task may hold in memory.
GROUP_ROWS = 100_000
BUCKETS = 4096


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    max_rows: int = GROUP_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One column per name in ``probabilities``, linearly interpolated, exact."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    edges = pin(
        rows.groupBy(*keys).agg(
            F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("_v").alias("_total")
        )
    )
    large = pin(edges.filter(F.col("_total") > max_rows))
    if large.isEmpty():
        return _built_in(rows, keys, probabilities)
    small_groups = rows.join(large.select(*keys), keys, "left_anti")
    narrowed = _narrowed(rows.join(large, keys), keys, probabilities, buckets)
    return _built_in(small_groups, keys, probabilities).unionByName(narrowed)


def _built_in(rows: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    levels = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    found = rows.groupBy(*keys).agg(F.percentile("_v", levels).alias("_q"))
    return found.select(
        *keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probabilities)]
    )


def position_of(p: float) -> tuple[Column, Column]:
    """Zero-based position of a quantile: the rank below and the fraction above it."""
    position = (F.col("_total") - 1) * float(p)
    return F.floor(position), position - F.floor(position)


def _narrowed(rows: DataFrame, keys: list[str], probabilities: dict[str, float], buckets: int) -> DataFrame:
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    bucket = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    placed = rows.withColumn("_bucket", F.coalesce(bucket, F.lit(0)).cast("int"))
    histogram = placed.groupBy(*keys, "_bucket", "_total").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``buckets`` rows per group.
    upto = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranged = histogram.withColumn("_before", upto - F.col("_n")).withColumn("_upto", upto)
    wanted = F.lit(False)
    for p in probabilities.values():
        below, fraction = position_of(p)
        for rank in (below, below + F.ceil(fraction)):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_upto")))
    targets = ranged.filter(wanted).select(*keys, "_bucket", "_before")
    kept = attach(placed, targets, [*keys, "_bucket"], "inner")
    counts = kept.groupBy(*keys, "_bucket", "_before", "_total", "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running_total(counts, "_n", [*keys, "_bucket"], ["_v"], "_inside", SERIES_ROWS)
    reached = F.col("_before") + F.col("_inside")
    found = []
    for name, p in probabilities.items():
        below, fraction = position_of(p)
        found.append(F.min(F.when(reached > below, F.col("_v"))).alias(f"_lo_{name}"))
        found.append(F.min(F.when(reached > below + F.ceil(fraction), F.col("_v"))).alias(f"_hi_{name}"))
        found.append(F.first(fraction).alias(f"_frac_{name}"))
    picked = ranked.groupBy(*keys).agg(*found)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") * (1 - F.col(f"_frac_{n}")) + F.col(f"_hi_{n}") * F.col(f"_frac_{n}")
            ).alias(n)
            for n in probabilities
        ],
    )

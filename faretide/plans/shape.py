"""Joins and ordered computations that stay even when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide.session import ensure_checkpoint_dir

# A result of at most this many narrow rows may pass through the driver.
LOCAL_ROWS = 50_000
# A side of at most this many narrow rows is small enough to send to every executor.
BROADCAST_ROWS = 500_000
# Rows of one key that a single task sorts comfortably.
SERIES_ROWS = 5_000_000
# Blocks that heavy keys are cut into. The driver hears of every block, so in very large tables blocks grow instead.
MAX_BLOCKS = 500


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counting stops at the limit."""
    return df.limit(max_rows + 1).count() <= max_rows


def pin(small: DataFrame, local_rows: int = LOCAL_ROWS, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A presumably small table, made ready to join according to its checked size.

    Up to ``local_rows`` rows it is computed once, here, so that neither the
    check nor later uses scan its source again. Up to ``max_rows`` rows it is
    marked for broadcast. Beyond that it is returned as it is, and joins with
    it shuffle, where AQE splits skewed partitions. Reading stops at the limit.
    """
    taken = small.limit(local_rows + 1).toArrow()
    if taken.num_rows <= local_rows:
        return F.broadcast(small.sparkSession.createDataFrame(taken, schema=small.schema))
    return F.broadcast(small) if is_small(small, max_rows) else small


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    local_rows: int = LOCAL_ROWS,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a presumably small side; it is broadcast only if its checked size allows."""
    return big.join(pin(small, local_rows, max_rows), list(on), how)


def heavy_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows: at most rows / max_rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > max_rows)


def split_heavy(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = SERIES_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Split ``df`` into ordinary keys and, if there are any, range blocks of the heavy ones.

    The first part keeps one group per key. The second part carries a column
    ``_block``: blocks of a key are disjoint ranges of ``order``, ascending, of
    roughly even size however skewed the keys or the order values are. It is
    checkpointed, so every later use sees the same blocks and a lost executor
    does not redraw the ranges. There are at most ``MAX_BLOCKS``; what the driver samples and keeps
    of them stays the same however many rows there are.
    """
    heavy = heavy_keys(df, keys, max_rows)
    found = heavy.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).first()
    if not found["n"]:
        return df, None
    ensure_checkpoint_dir(df.sparkSession)
    heavy = heavy.select(*keys).checkpoint()
    light = attach(df, heavy, keys, "left_anti")
    blocks = min(-(-found["rows"] // max_rows) * 2, MAX_BLOCKS)
    ranged = (
        attach(df, heavy, keys, "left_semi")
        .repartitionByRange(blocks, *keys, *order)
        .withColumn("_block", F.spark_partition_id())
        .checkpoint()
    )
    return light, ranged


def lag_in_series(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    prefix: str = "prev_",
    max_rows: int = SERIES_ROWS,
) -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` in the preceding row of the same key.

    Ordinary keys take one shuffle and one sort. A heavy key is read in range
    blocks, and only the last row of each block travels to the next one.
    """
    light, heavy = split_heavy(df, keys, order, max_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = light.select("*", *[F.lag(c).over(window).alias(prefix + c) for c in columns])
    if heavy is None:
        return out
    block = Window.partitionBy(*keys, "_block").orderBy(*order)
    inside = heavy.select(
        "*",
        *[F.lag(c).over(block).alias(prefix + c) for c in columns],
        (F.row_number().over(block) == 1).alias("_first"),
    )
    # One row per block of a heavy key.
    ends = heavy.groupBy(*keys, "_block").agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_end")
    )
    carried = ends.select(
        *keys, "_block", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    joined = attach(inside, carried, [*keys, "_block"])
    joined = joined.select(
        *df.columns,
        *[
            F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(prefix + c)).alias(prefix + c)
            for c in columns
        ],
    )
    return out.unionByName(joined)


def running_total(
    df: DataFrame,
    value: str | Column,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    max_rows: int = SERIES_ROWS,
) -> DataFrame:
    """Add the running sum of ``value`` within each key, current row included."""
    df = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    light, heavy = split_heavy(df, keys, order, max_rows)
    rows = (Window.unboundedPreceding, Window.currentRow)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*rows)
    out = light.withColumn(name, F.sum("_value").over(window))
    if heavy is not None:
        block = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(*rows)
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = heavy.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
        offsets = sums.select(
            *keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
        )
        inside = heavy.withColumn(name, F.sum("_value").over(block))
        joined = attach(inside, offsets, [*keys, "_block"])
        joined = joined.withColumn(name, F.col(name) + F.col("_offset"))
        out = out.unionByName(joined.select(*out.columns))
    return out.drop("_value")

"""Shared tables, sorted groups and running offsets for the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide.session import scratch_path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends there, so a lost executor repeats one step only, and the shuffles behind
    the table can be freed.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more, and let Spark drop finished shuffles."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = hadoop.Path(t._kept_path)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return the free memory of this process to the system.

    Workers outlive their tasks, so what the allocators hold of one step would stand beside the next.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def released(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches that gives the worker's free memory back when its task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows with equal ``key`` in batches sorted by it; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        table = pa.Table.from_batches([batch])
        a = 0
        for b in range(1, len(keys) + 1):
            if b < len(keys) and keys[b] == keys[a]:
                continue
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            last = keys[a]
            held.append(table.slice(a, b - a))
            a = b
    if held:
        yield pa.concat_tables(held)


def grouped(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Apply ``function`` (groups -> batches) to the groups of ``key``, several to a task."""
    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(
        released(lambda batches: function(runs(batches, key))), schema
    )


def keep_numbered(df: DataFrame, label: str) -> DataFrame:
    """``keep`` with the part that wrote each row, and the row's place, in ``_part`` and ``_row``.

    Both are read back from the table, so they stay the same however its files are split later.
    """
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    return keep(placed, label)


def rank_within(stored: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in arbitrary but gapless order, hot keys included.

    ``stored`` is a table of ``keep_numbered``. Rows are numbered inside each part; only one row per
    key and part is shuffled to find where each part's numbers start.
    """
    order = Window.partitionBy("_part", *keys).orderBy("_row")
    counts = stored.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = stored.withColumn("_local", F.row_number().over(order) - 1)
    joined = local.join(starts, ["_part", *keys])
    columns = [c for c in stored.columns if c not in ("_part", "_row")]
    return joined.select(*columns, (F.col("_local") + F.col("_start")).cast("long").alias(name))


def rank_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in ``order``, hot keys included.

    Rows are range-partitioned by key and order, so a key with many rows spreads over many tasks; each
    task numbers its own rows, and one row per key and task tells where its numbers start.
    """
    placed = keep(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered"
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = placed.withColumn("_local", F.row_number().over(inside) - 1).alias("l")
    same = F.col("l._part") == F.col("s._part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = local.join(starts.alias("s"), same)
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("_local") + F.col("_start")).cast("long").alias(name)
    )

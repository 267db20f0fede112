"""Pages of a large ordered table from an index of its parts.

The table is written once in order: dealt by range of the sort keys, sorted inside each part, with every row's place in
its part. The index has one row per part: where its numbers begin, how many rows it has, and its first key. A page, however deep, is
then read from the parts that hold its numbers (or that begin at its key), by place: other parts are not opened and nothing is
sorted but the page itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv

# (column, descending) from the most significant on.
Order = Sequence[tuple[str, bool]]

_LOCAL = (1 << 33) - 1


def _sorted(order: Order) -> list[Column]:
    """Missing values stand last in either direction."""
    return [F.desc_nulls_last(c) if desc else F.asc_nulls_last(c) for c, desc in order]


def store_pages(df: DataFrame, path: str, order: Order, parts: int | None = None) -> None:
    """Write ``df`` in ``order``, whose columns tell all rows apart, with its page index.

    A key that very many rows share in its leading columns is spread by the others.
    """
    by = _sorted(order)
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    # The low bits of the id count the rows of a task, after the sort.
    placed = dealt.sortWithinPartitions(*by).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)).alias("_place"),
    )
    placed.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows")
    # An empty file keeps the columns, which a partitioned table without rows has not.
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    rows = _stored(df.sparkSession, path)
    keys = F.struct(*[F.col(c) for c, _ in order])
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"), F.min_by(keys, "_place").alias("_first"))
    # One row per part.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    index = counts.withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str, wanted: list[tuple[int, int, int]]) -> DataFrame:
    """Rows of (part, first place, last place)."""
    rows = _stored(spark, path)
    if not wanted:
        return rows.filter(F.lit(False))
    inside = F.lit(False)
    for part, low, high in wanted:
        inside = inside | ((F.col("_part") == part) & F.col("_place").between(low, high))
    # The filter on parts stands alone, so that folders are pruned by it.
    return rows.filter(F.col("_part").isin(*[w[0] for w in wanted])).filter(inside)


def _numbered(spark: SparkSession, path: str, rows: DataFrame, starts: dict[int, int]) -> DataFrame:
    """Rows with their number in the whole table (``position``, from 1) and the number of all rows."""
    start = F.lit(0).cast("long")
    for part, at in starts.items():
        start = F.when(F.col("_part") == part, F.lit(at).cast("long")).otherwise(start)
    total = _parts(spark, path).agg(F.sum("_count")).first()[0] or 0
    numbered = rows.withColumn("position", start + F.col("_place") + 1).withColumn("total", F.lit(total).cast("long"))
    return numbered.drop("_part", "_place").orderBy("position")


def read_page(spark: SparkSession, path: str, number: int = 1, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) with ``position`` and ``total``; empty beyond the last page.

    Of the index, the rows of the parts that the page touches reach the driver: at most ``size``.
    """
    low, high = (number - 1) * size, number * size
    found = _parts(spark, path).filter((F.col("_start") < high) & (F.col("_start") + F.col("_count") > low)).collect()
    wanted = [(r["_part"], low - r["_start"], high - 1 - r["_start"]) for r in found]
    rows = _rows(spark, path, wanted)
    return _numbered(spark, path, rows, {r["_part"]: r["_start"] for r in found})


def _after(values: Sequence, columns: Sequence[Column], order: Order) -> Column:
    """Whether a row's keys come after ``values``, which are not missing."""
    after = F.lit(False)
    for value, column, (_, desc) in reversed(list(zip(values, columns, order))):
        later = (column < value) if desc else (column > value)
        after = column.isNull() | later | ((column == value) & after)
    return after


def read_after(
    spark: SparkSession, path: str, order: Order, values: Sequence, size: int = fv.PAGE_SIZE
) -> DataFrame:
    """The ``size`` rows that follow the row with these sort ``values``, by key instead of by number.

    The part in which the values lie and the parts behind it that the page may reach are read.
    """
    first = [F.col("_first")[c] for c, _ in order]
    # The last part that begins at or before the values, and those behind it until they hold enough rows.
    behind = _after(values, first, order)
    index = _parts(spark, path)
    own = index.filter(~F.coalesce(behind, F.lit(False))).agg(F.max(F.struct("_part", "_start", "_count")).alias("o")).first()["o"]
    begin = own["_start"] + own["_count"] if own else 0
    later = index.filter(behind & (F.col("_start") < begin + size)).collect()
    rows = [own, *later] if own else later
    wanted = [(r["_part"], 0, r["_count"]) for r in rows]
    kept = _rows(spark, path, wanted).filter(_after(values, [F.col(c) for c, _ in order], order))
    return _numbered(spark, path, kept, {r["_part"]: r["_start"] for r in rows}).limit(size)

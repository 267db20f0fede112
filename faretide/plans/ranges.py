"""Joins of points with intervals, without comparing every point with every interval.

An interval lies in at most two neighbouring cells of the least power of two that is not below its width. That power is
its level. A point has one cell on each level that occurs, so points and intervals meet by an equi join on
(level, cell), and a pair meets at most once. Cells are at most twice as wide as their intervals, so few pairs
that meet do not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide.plans.shape import attach
from faretide.session import ensure_checkpoint_dir

# Levels below the greatest value's own; narrower intervals share the narrowest cells.
LEVELS = 45


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level))


def range_join(points: DataFrame, bands: DataFrame, value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Every point with every band that holds its ``value``: ``low <= value <= high``.

    A missing end is open. Bands may overlap, be of any number and width, and have any further columns, whose names
    must differ from those of the points. Points without a value, or with NaN, are in no band, and a band
    with an end of NaN or with its ends crossed holds nothing.

    The bands are broadcast if their checked size allows; points are then read as they lie. Beyond that both sides
    are dealt by cell, where a value that very many points share is split by AQE.
    """
    numbered = points.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    ends = bands.select("*", lo.alias("_lo"), hi.alias("_hi"))
    ends = ends.filter(~F.coalesce(F.isnan("_lo"), F.lit(False)) & ~F.coalesce(F.isnan("_hi"), F.lit(False)))
    ends = ends.filter(F.coalesce(F.col("_lo") <= F.col("_hi"), F.lit(True)))
    # Open ends reach as far as the finite values do; infinite values count as the outermost of these.
    number = F.col(value).cast("double")
    finite = F.when(F.abs(number) < float("inf"), number)
    least, most = numbered.agg(F.min(finite), F.max(finite)).first()
    least, most = (0.0, 0.0) if least is None else (least, most)
    floor = F.ceil(F.log2(F.lit(max(abs(least), abs(most), 1e-300)))) - LEVELS
    clip = lambda c: F.greatest(F.least(c, F.lit(most)), F.lit(least))
    a, b = clip(F.coalesce("_lo", F.lit(least))), clip(F.coalesce("_hi", F.lit(most)))
    ends = ends.withColumn("_a", a).withColumn("_b", b)
    ends = ends.withColumn("_level", F.greatest(F.coalesce(F.ceil(F.log2(F.col("_b") - F.col("_a"))), floor), floor))
    first, last = _cell(F.col("_a"), F.col("_level")), _cell(F.col("_b"), F.col("_level"))
    celled = ends.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last)))).drop("_a", "_b")
    # A handful of numbers: as many as bands have orders of width.
    levels = sorted(r[0] for r in ends.select("_level").distinct().collect())
    if not levels:
        return numbered.withColumn("_none", F.lit(0)).join(bands.withColumn("_none", F.lit(0)).limit(0), "_none").drop("_none")
    spread = numbered.withColumn("_level", F.explode(F.array(*[F.lit(x).cast("bigint") for x in levels])))
    spread = spread.withColumn("_cell", _cell(clip(number), F.col("_level")))
    met = attach(spread, celled, ["_level", "_cell"], "inner")
    inside = F.coalesce(number >= F.col("_lo"), F.lit(True)) & F.coalesce(number <= F.col("_hi"), F.lit(True))
    return met.filter(inside).select(*points.columns, *bands.columns)


def range_totals(
    points: DataFrame, bands: DataFrame, value: str, name: str = "band", low: str = "low", high: str = "high"
) -> DataFrame:
    """``name, n, least, most`` of the points in each band: what ``range_join`` gives, grouped by ``name``, without its rows.

    Bands that hold many points each make as many rows in a join as both tables multiplied. Here points and band ends are put
    in one order instead. A running count gives how many points lie below an end, and a running extreme the nearest point on
    its inner side, so the work is one sort of both tables, whatever the bands hold. Bands may overlap and share a name;
    those that hold nothing have no row. Missing ends, NaN and crossed ends count as in ``range_join``.
    """
    ensure_checkpoint_dir(points.sparkSession)
    number = lambda c: F.when(c.cast("double") == 0, F.lit(0.0)).otherwise(c.cast("double"))
    # One row per distinct value, so a value that very many points share is one row.
    valued = points.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).alias("_value"))
    counted = valued.agg(F.count(F.lit(1)).alias("_n")).select(
        number(F.col("_value")).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_salt"), "_n", "_value"
    )
    lo = F.coalesce(number(F.col(low)), F.lit(float("-inf")))
    hi = F.coalesce(number(F.col(high)), F.lit(float("inf")))
    ends = bands.select(F.col(name), lo.alias("_lo"), hi.alias("_hi"))
    ends = ends.filter(~F.isnan("_lo") & ~F.isnan("_hi") & (F.col("_lo") <= F.col("_hi")))
    # Lower ends stand before the points of their value, upper ends behind. Equal ends spread by the hash of their band.
    side = lambda at, kind, other: ends.select(
        F.col(at).alias("_at"), F.lit(kind).alias("_kind"), F.xxhash64(name, "_lo", "_hi").alias("_salt"),
        F.col(name), F.col(other).alias("_other"),
    )
    both = side("_lo", 0, "_hi").unionByName(side("_hi", 2, "_lo"))
    order = ["_at", "_kind", "_salt"]
    placed = (
        counted.unionByName(both, allowMissingColumns=True)
        .repartitionByRange(*order)
        .withColumn("_block", F.spark_partition_id())
        .checkpoint()
    )
    # One row per block: what lies before it, and the nearest points on either side of it.
    total = placed.groupBy("_block").agg(
        F.sum("_n").alias("_n"),
        F.min_by("_value", F.when(F.col("_kind") == 1, F.col("_at"))).alias("_first"),
        F.max_by("_value", F.when(F.col("_kind") == 1, F.col("_at"))).alias("_last"),
    )
    over = Window.orderBy("_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(
        "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.last("_last", ignorenulls=True).over(before).alias("_prev"),
        F.last("_first", ignorenulls=True).over(behind).alias("_next"),
    )
    up = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = (
        Window.partitionBy("_block").orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = placed.select(
        "*",
        F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_upto"),
        F.last("_value", ignorenulls=True).over(up).alias("_below"),
        F.last("_value", ignorenulls=True).over(down).alias("_above"),
    )
    joined = attach(inside.filter("_kind <> 1"), carried, ["_block"])
    upto = F.col("_upto") + F.col("_n_before")
    lower = F.col("_kind") == 0
    above, below = F.coalesce("_above", "_next"), F.coalesce("_below", "_prev")
    # The nearest point of an empty band lies beyond its other end.
    least = F.when(lower & (above.cast("double") <= F.col("_other")), above)
    most = F.when(~lower & (below.cast("double") >= F.col("_other")), below)
    found = joined.groupBy(name).agg(
        F.sum(F.when(lower, -upto).otherwise(upto)).alias("n"), F.min(least).alias("least"), F.max(most).alias("most")
    )
    return found.filter("n > 0")

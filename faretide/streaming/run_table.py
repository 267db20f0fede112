"""Runs kept up to date batch by batch: stored time cells, numbers repaired where late rows join or split runs.

Rows are reduced to cells (see ``plans.runs``), and cells lie in blocks of ``CELLS`` cells, a day at a gap of five minutes.
A batch appends its own cells, reads the cells of the blocks it touches, and appends one summary per touched block: first and last
time, and how many runs start inside it. Both appends overwrite only what the same batch wrote before, and cells of one
place merge by least and greatest time, so a batch may be repeated.

A run's number is the number of runs that start up to it. Summaries give that number at the beginning of each block,
one row per dataset and block, so a late row that joins two runs lowers the numbers of all later runs without any
later cell being read or written.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.plans.runs import cell_of, gap_micros
from faretide.plans.shape import attach

# Cells of one block.
CELLS = 288
# Up to so many touched blocks are named one by one in the filter on stored cells; beyond, by their range and a join.
NAMED_BLOCKS = 1000

_CELL = "_cell long, _first long, _last long, ingest_batch long, dataset string, block long"
_BLOCK = "dataset string, block long, first long, last long, starts long, last_start long, ingest_batch long"


def _block(cell: Column) -> Column:
    return ((cell - F.pmod(cell, F.lit(CELLS))) / F.lit(CELLS)).cast("bigint")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _append(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Write the rows of a batch; what the same batch wrote to these partitions before is replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def _of_blocks(cells: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored cells of the touched blocks; folders of other blocks are not opened."""
    named = touched.limit(NAMED_BLOCKS + 1).collect()
    if not named:
        return cells.filter(F.lit(False))
    if len(named) <= NAMED_BLOCKS:
        per: dict[str, list[int]] = {}
        for r in named:
            per.setdefault(r["dataset"], []).append(r["block"])
        wanted = [(F.col("dataset") == d) & F.col("block").isin(*sorted(blocks)) for d, blocks in per.items()]
        return cells.filter(reduce(lambda a, b: a | b, wanted))
    low, high = touched.agg(F.min("block"), F.max("block")).first()
    return attach(cells.filter(F.col("block").between(low, high)), touched, ["dataset", "block"], "left_semi")


def _merged(cells: DataFrame) -> DataFrame:
    """One row per cell, whatever batches it came in, with the idle time before it inside its block."""
    merged = cells.groupBy("dataset", "block", "_cell").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    inside = Window.partitionBy("dataset", "block").orderBy("_cell")
    return merged.withColumn("_idle", F.col("_first") - F.lag("_last").over(inside))


def fold_runs(batch: DataFrame, path: str, batch_id: int, gap: str | timedelta = fv.RUN_GAP) -> None:
    """Put the rows of a batch into the run table at ``path``; ``gap`` is the same for all batches of a table.

    Rows without a dataset name or time belong to no run.
    """
    spark, width = batch.sparkSession, gap_micros(gap)
    us = F.unix_micros("observed_at")
    rows = batch.filter("dataset <> '' and observed_at is not null")
    cells = rows.groupBy("dataset", cell_of(us, width).alias("_cell")).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last")
    )
    placed = cells.select(
        "_cell", "_first", "_last", F.lit(batch_id).cast("long").alias("ingest_batch"), "dataset",
        _block(F.col("_cell")).alias("block"),
    )
    _append(placed, f"{path}/cells", ["ingest_batch", "dataset", "block"])
    stored = _stored(spark, f"{path}/cells", _CELL)
    touched = stored.filter(F.col("ingest_batch") == batch_id).select("dataset", "block").distinct()
    merged = _merged(_of_blocks(stored, touched))
    starts = F.col("_idle") > width
    summary = merged.groupBy("dataset", "block").agg(
        F.min("_first").alias("first"),
        F.max("_last").alias("last"),
        F.count_if(starts).alias("starts"),
        F.max(F.when(starts, F.col("_first"))).alias("last_start"),
        F.lit(batch_id).cast("long").alias("ingest_batch"),
    )
    _append(summary.coalesce(1), f"{path}/blocks", ["ingest_batch"])


def _numbered_blocks(spark: SparkSession, path: str, width: int) -> DataFrame:
    """The newest summary of every block with the number of runs, and the start of the last run, before it."""
    newest = _stored(spark, f"{path}/blocks", _BLOCK).groupBy("dataset", "block").agg(
        F.max_by(F.struct("first", "last", "starts", "last_start"), "ingest_batch").alias("s")
    )
    # One row per dataset and block; a block is a day or so.
    order = Window.partitionBy("dataset").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = newest.select("dataset", "block", "s.*").withColumn(
        "opens", F.coalesce(F.col("first") - F.lag("last").over(order) > width, F.lit(True))
    )
    own = F.coalesce("last_start", F.when(F.col("opens"), F.col("first")))
    return blocks.select(
        "dataset",
        "block",
        "opens",
        F.coalesce(F.sum(F.col("starts") + F.col("opens").cast("bigint")).over(before), F.lit(0)).alias("runs_before"),
        F.last(own, ignorenulls=True).over(before).alias("start_before"),
    )


def stored_run_cells(
    spark: SparkSession,
    path: str,
    gap: str | timedelta = fv.RUN_GAP,
    days: tuple[date, date] | None = None,
) -> DataFrame:
    """The cells of ``plans.runs.run_cells`` over all rows folded so far, to tag rows with runs.

    With ``days`` (first and last, included), only the cells of blocks that touch these days are read; numbers stay the same.
    """
    width = gap_micros(gap)
    cells = _stored(spark, f"{path}/cells", _CELL)
    blocks = _numbered_blocks(spark, path, width)
    if days:
        edge = lambda day: _block(cell_of(F.unix_micros(F.lit(day).cast("timestamp")), width))
        inside = F.col("block").between(edge(days[0]), edge(days[1] + timedelta(days=1)))
        cells, blocks = cells.filter(inside), blocks.filter(inside)
    joined = attach(_merged(cells), blocks, ["dataset", "block"], "inner")
    starts = F.coalesce(F.col("_idle") > width, F.col("opens"))
    so_far = Window.partitionBy("dataset", "block").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max(F.when(starts, F.col("_first"))).over(so_far), F.col("start_before"))
    return joined.select(
        "dataset",
        "_cell",
        "_first",
        "_last",
        (F.col("runs_before") + F.sum(starts.cast("bigint")).over(so_far)).alias("run_id"),
        F.timestamp_micros(start).alias("run_start"),
    )


def stored_runs(spark: SparkSession, path: str, gap: str | timedelta = fv.RUN_GAP) -> DataFrame:
    """One row per run of all rows folded so far: ``dataset, run_id, run_start, run_end``."""
    return stored_run_cells(spark, path, gap).groupBy("dataset", "run_id").agg(
        F.min("run_start").alias("run_start"), F.timestamp_micros(F.max("_last")).alias("run_end")
    )


def run_table_stream(stream: DataFrame, path: str, checkpoint: str, gap: str | timedelta = fv.RUN_GAP) -> None:
    """Fold everything that ``stream`` holds now into the run table, rows of any age included."""
    query = (
        stream.select("dataset", "observed_at")
        .writeStream.foreachBatch(lambda batch, batch_id: fold_runs(batch, path, batch_id, gap))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

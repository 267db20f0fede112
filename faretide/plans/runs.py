"""Collection runs: maximal stretches of a dataset without a gap longer than ``gap``.

Two rows in one time cell of width ``gap`` are closer than ``gap``, so a run
can only start at the first row of a cell. It is therefore enough to keep the
first and last time of each non-empty cell, which is a map-side aggregate, and
to look for gaps between neighbouring cells. No row is sorted, a hot dataset
or a hot minute costs nothing extra, and the cell table holds at most
time span / gap rows per dataset.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.plans.shape import pin

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def gap_micros(gap: str | timedelta) -> int:
    if isinstance(gap, timedelta):
        return (gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds
    count, unit = gap.split()
    return int(count) * _UNITS[unit.rstrip("s")] * 1_000_000


def cell_of(micros: Column, width: int) -> Column:
    """The number of the time cell of ``width`` microseconds."""
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("bigint")


def run_cells(obs: DataFrame, gap: str | timedelta = fv.RUN_GAP) -> DataFrame:
    """One row per non-empty (dataset, cell) with the run it belongs to."""
    width = gap_micros(gap)
    micros = F.unix_micros("observed_at")
    cells = obs.groupBy("dataset", cell_of(micros, width).alias("_cell")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last")
    )
    in_time = Window.partitionBy("dataset").orderBy("_cell")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    idle = F.col("_first") - F.lag("_last").over(in_time)
    cells = cells.withColumn("_starts", F.coalesce(idle > width, F.lit(True)))
    return cells.select(
        "dataset",
        "_cell",
        "_first",
        "_last",
        F.sum(F.col("_starts").cast("bigint")).over(so_far).alias("run_id"),
        F.timestamp_micros(F.max(F.when(F.col("_starts"), F.col("_first"))).over(so_far)).alias(
            "run_start"
        ),
    )


def tag_runs(
    obs: DataFrame, gap: str | timedelta = fv.RUN_GAP, cells: DataFrame | None = None
) -> DataFrame:
    """Observations with ``run_id`` (1, 2, ... per dataset) and ``run_start``.

    ``cells`` takes a pinned result of ``run_cells``, to share it.
    """
    width = gap_micros(gap)
    cells = pin(run_cells(obs, gap)) if cells is None else cells
    celled = obs.withColumn("_cell", cell_of(F.unix_micros("observed_at"), width))
    runs = cells.select("dataset", "_cell", "run_id", "run_start")
    return celled.join(runs, ["dataset", "_cell"]).drop("_cell")


def run_times(obs: DataFrame, gap: str | timedelta = fv.RUN_GAP) -> DataFrame:
    """One row per run: when it started and ended."""
    return (
        run_cells(obs, gap)
        .groupBy("dataset", "run_id")
        .agg(
            F.min("run_start").alias("run_start"),
            F.timestamp_micros(F.max("_last")).alias("run_end"),
        )
    )


def run_prices(tagged: DataFrame) -> DataFrame:
    """Last price of every item in every run."""
    return tagged.groupBy("dataset", "run_id", "hotel_name").agg(
        F.min("run_start").alias("run_start"),
        F.max_by("price", F.struct("observed_at", "seq")).alias("price"),
    )

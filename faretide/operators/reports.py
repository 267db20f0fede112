"""Report contents as rows of (dataset, section, position, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.functions.money import signed_pct, signed_whole, whole
from faretide.functions.timestamps import iso_text
from faretide.operators.alerts import alert_counts, top_alerts
from faretide.operators.changes import movers
from faretide.operators.filters import drops, increases
from faretide.operators.ranking import rank_per, top_offers
from faretide.operators.stats import kpis
from faretide.plans.shape import SERIES_ROWS, running_total


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rows(df: DataFrame, section: str | Column, line: Column) -> DataFrame:
    return df.select(
        "dataset",
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        F.col("position").cast("bigint").alias("position"),
        line.alias("line"),
    )


def _two_decimals(col: Column) -> Column:
    return col.cast("decimal(38,2)").cast("string")


def comparison_rows(missing: DataFrame, cheaper: DataFrame, limit: int = fv.REPORT_LIMIT) -> DataFrame:
    """Airport comparison: cheapest missing items and largest savings."""

    def ranked(df: DataFrame, *order: Column) -> DataFrame:
        if "dataset" not in df.columns:
            df = df.withColumn("dataset", F.lit("all"))
        return rank_per(df, ["dataset"], list(order), limit)

    gone = ranked(missing, F.asc("price"), F.asc("hotel_name"))
    better = ranked(cheaper, F.desc("savings"), F.asc("hotel_name"))
    name = F.col("hotel_name")
    return _rows(
        gone,
        "missing",
        _line(F.left(name, F.lit(50)), " | ", whole(F.col("price")), " PLN | ", F.coalesce("departure_airport", F.lit(""))),
    ).unionByName(
        _rows(
            better,
            "cheaper",
            _line(
                F.left(name, F.lit(40)),
                " | ",
                whole(F.col("base_price")),
                " PLN | ",
                F.coalesce("best_departure_airport", F.lit("")),
                ": ",
                whole(F.col("best_other_price")),
                " PLN | ",
                whole(F.col("savings")),
                " PLN (",
                F.col("savings_percent").cast("decimal(38,1)").cast("string"),
                "%)",
            ),
        )
    )


def _change_line(name_width: int) -> Column:
    return _line(
        F.left("hotel_name", F.lit(name_width)),
        ": ",
        whole(F.col("old_price")),
        " → ",
        whole(F.col("new_price")),
        " PLN, ",
        signed_whole(F.col("price_change")),
        " PLN (",
        signed_pct(F.col("price_change_pct")),
        ")",
    )


def alert_report_rows(alerts: DataFrame, max_rows: int = SERIES_ROWS) -> DataFrame:
    """All drops and all rises, numbered by item and time."""
    sides = drops(alerts).withColumn("section", F.lit("drop")).unionByName(
        increases(alerts).withColumn("section", F.lit("increase"))
    )
    order = ["hotel_name", "changed_at", "old_price", "new_price"]
    numbered = running_total(
        sides, F.lit(1).cast("bigint"), ["dataset", "section"], order, "position", max_rows
    )
    line = _line(_change_line(50), ", ", F.substring(iso_text(F.col("changed_at")), 1, 19))
    return _rows(numbered, F.col("section"), line)


def alert_summary_rows(alerts: DataFrame, n: int = 10) -> DataFrame:
    """Counts, then the n largest changes each way."""
    counts = alert_counts(alerts).select(
        "dataset",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("count").alias("section"),
                        F.lit(i).cast("bigint").alias("position"),
                        _line(label + ": ", F.col(c).cast("string")).alias("line"),
                    )
                    for i, (label, c) in enumerate(
                        [("total", "total"), ("drops", "drops"), ("increases", "increases")], 1
                    )
                ]
            )
        ),
    )
    line = _line(
        F.col("hotel_name"),
        ": ",
        F.col("old_price").cast("string"),
        " → ",
        F.col("new_price").cast("string"),
        " PLN (",
        signed_pct(F.col("price_change_pct")),
        ")",
    )
    return counts.unionByName(_rows(top_alerts(alerts, n), F.col("side"), line))


def price_report_rows(obs: DataFrame, n: int = 5) -> DataFrame:
    """Dataset totals and the n cheapest offers."""
    facts = [
        ("offers", F.col("offers").cast("string")),
        ("hotels", F.col("hotels").cast("string")),
        ("mean", _two_decimals(F.col("mean_price"))),
        ("min", _two_decimals(F.col("min_price"))),
        ("max", _two_decimals(F.col("max_price"))),
    ]
    totals = kpis(obs).select(
        "dataset",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("statistics").alias("section"),
                        F.lit(i).cast("bigint").alias("position"),
                        _line(label + ": ", value).alias("line"),
                    )
                    for i, (label, value) in enumerate(facts, 1)
                ]
            )
        ),
    )
    line = _line(
        F.col("hotel_name"),
        " - ",
        _two_decimals(F.col("price")),
        " PLN | ",
        F.coalesce("dates", F.lit("")),
        " | ",
        iso_text(F.col("observed_at")),
    )
    return totals.unionByName(_rows(top_offers(obs, n), "cheapest", line))


def snapshot_rows(changes: DataFrame, n: int = 10) -> DataFrame:
    """The first n significant changes of a snapshot, largest first."""
    largest = rank_per(changes, ["dataset"], [F.desc(F.abs("price_change")), F.asc("hotel_name")], n)
    mark = F.when(F.col("price_change") > 0, F.lit("📈 ")).otherwise(F.lit("📉 "))
    return _rows(largest, "snapshot", _line(mark, _change_line(40)))


def mover_rows(obs: DataFrame, hours=(24, 168), n: int = 5) -> DataFrame:
    """Largest falls and rises of each window."""
    section = F.concat_ws("_", F.col("side"), F.concat(F.col("window_hours").cast("string"), F.lit("h")))
    return _rows(movers(obs, hours, n), section, _change_line(100))

"""Runnable queries on the star-schema tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


# Columns that hold means or differences of means.
MEANS = ("mean_price", "avg_price", "mean", "avg_change", "avg_change_pct")


def plain(df: DataFrame) -> DataFrame:
    """The forms in which results are compared: UTC wall-clock instants, days as text, means at six decimals."""

    def shown(field: T.StructField):
        if field.name in MEANS and isinstance(field.dataType, T.DoubleType):
            return F.round(F.round(field.name, 9), 6).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.col(field.name).cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(build(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = Query(name, run, sql)
        return build

    return add


def load() -> dict[str, Query]:
    """All queries, in registration order."""
    from faretide.registry import (  # noqa: F401
        airport_queries,
        change_queries,
        document_queries,
        filter_queries,
        pane_queries,
        report_queries,
        run_queries,
        stats_queries,
        stream_queries,
        text_queries,
    )

    return QUERIES

"""Top-k, first/last per key, ordering and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv


def top_k(df: DataFrame, by: str, k: int, desc: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows of an ordering: a bounded heap per task, no full sort."""
    lead = F.desc(by) if desc else F.asc(by)
    return df.orderBy(lead, *tie).limit(k)


def rank_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "position") -> DataFrame:
    """First ``k`` rows of every key with their position.

    The rank filter is pushed below the shuffle, so a key sends at most ``k``
    rows per task however many it has.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def top_offers(obs: DataFrame, n: int = 10, cheapest: bool = True) -> DataFrame:
    """The n cheapest (or dearest) rows of every dataset; earlier rows win ties."""
    lead = F.asc_nulls_last("price") if cheapest else F.desc_nulls_last("price")
    return rank_per(obs, ["dataset"], [lead, F.asc("seq")], n)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of every key: one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def sort_by(df: DataFrame, column: str, desc: bool = False, tie: Sequence[str] = ("hotel_name",)) -> DataFrame:
    """Whole ordering by a column of the table, nulls last; ``tie`` decides, and the dataset where there is one."""
    if column not in df.columns:
        raise ValueError(f"cannot sort by {column!r}")
    lead = F.desc_nulls_last(column) if desc else F.asc_nulls_last(column)
    last = [c for c in ("dataset",) if c in df.columns and c not in tie]
    return df.orderBy(lead, *tie, *last)


def page(df: DataFrame, number: int = 1, size: int = fv.PAGE_SIZE) -> DataFrame:
    """One page of an ordered table, with ``shown_from``, ``shown_to`` and ``total``."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    start = (number - 1) * size
    return (
        df.offset(start)
        .limit(size)
        .withColumn("total", total)
        .withColumn("shown_from", F.lit(start + 1).cast("bigint"))
        .withColumn("shown_to", F.least(F.lit(start + size).cast("bigint"), F.col("total")))
    )

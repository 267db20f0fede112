"""Alerts from a stream of observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faretide import fixed_values as fv
from faretide.operators.alerts import new_alerts
from faretide.operators.changes import as_alerts, consecutive_changes
from faretide.schema import KEY
from faretide.session import drop_path, scratch_path
from faretide.streaming.core import watermarked

_PAIRS = (
    "dataset string, hotel_name string, kind string, old_price double, new_price double, changed_us long"
)
_LAST_SEEN = "observed_us long, seq long, price double, reported boolean"


def _step(timeout_ms: int | None):
    """State function: the last (time, seq, price) of an item; emits pairs of neighbours.

    Rows of one micro-batch arrive unordered, so they are sorted here. Rows at
    or before the stored position are late: ``repaired_alerts`` puts their alerts right. An item
    reported missing keeps its last price, so its return is compared with it.
    """

    def emit(key, kind, old, new, at) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "dataset": key[0],
                "hotel_name": key[1],
                "kind": kind,
                "old_price": old,
                "new_price": new,
                "changed_us": at,
            }
        )

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, seq, price, _ = state.get
            state.update((at, seq, price, True))
            yield emit(key, "missing", [price], [np.nan], [at])
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["observed_us", "seq"])
        at, seq, price = (c.to_numpy() for c in (rows["observed_us"], rows["seq"], rows["price"]))
        if state.exists:
            last_at, last_seq, last_price, _ = state.get
            fresh = (at > last_at) | ((at == last_at) & (seq > last_seq))
            at, seq, price = at[fresh], seq[fresh], price[fresh]
            before = np.concatenate([[last_price], price[:-1]]) if len(price) else price
            pairs = (before, price, at)
        else:
            pairs = (price[:-1], price[1:], at[1:])
        if len(at):
            state.update((int(at[-1]), int(seq[-1]), float(price[-1]), False))
        if timeout_ms is not None and state.exists and not state.get[3]:
            last_ms = state.get[0] // 1000
            state.setTimeoutTimestamp(max(last_ms + timeout_ms, state.getCurrentWatermarkMs() + 1))
        if len(pairs[2]):
            yield emit(key, "change", *pairs)

    return step


def pair_stream(
    stream: DataFrame, delay: str = "1 hour", missing_after_hours: float | None = None
) -> DataFrame:
    """Consecutive price pairs of every item, and ``missing`` rows for items that stay away.

    State is one small row per item. A micro-batch of one item is held by one
    task; ``maxFilesPerTrigger`` of the source bounds it.
    """
    timeout_ms = None if missing_after_hours is None else int(missing_after_hours * 3_600_000)
    mode = (
        GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.EventTimeTimeout
    )
    rows = watermarked(stream, delay).select(
        *KEY, "price", "seq", "observed_at", F.unix_micros("observed_at").alias("observed_us")
    )
    pairs = rows.groupBy(*KEY).applyInPandasWithState(
        _step(timeout_ms), _PAIRS, _LAST_SEEN, "append", mode
    )
    return pairs.withColumn("changed_at", F.timestamp_micros("changed_us")).drop("changed_us")


def alert_stream(
    stream: DataFrame, threshold: float = fv.ALERT_THRESHOLD_PCT, delay: str = "1 hour"
) -> DataFrame:
    """Alerts between consecutive observations, scored by column expressions after the state step."""
    pairs = pair_stream(stream, delay).filter(F.col("kind") == "change").drop("kind")
    return as_alerts(pairs, threshold, signed=False)


def repaired_alerts(
    history: DataFrame, table: DataFrame, late: DataFrame, threshold: float = fv.ALERT_THRESHOLD_PCT
) -> DataFrame:
    """The alert history with the alerts of all items that late rows touch recomputed from the whole table.

    A late row changes the neighbours of its item, so alerts between rows that no longer follow each
    other go and the new ones come; alerts of other items stay. Equal to the batch alerts of the table.
    """
    touched = late.select(*KEY).distinct()
    fresh = consecutive_changes(table.join(touched, KEY, "left_semi"), threshold)
    return history.join(touched, KEY, "left_anti").unionByName(fresh.select(*history.columns))


def emit_once(alerts: DataFrame, delay: str = "1 day", key: str = "unique_key") -> DataFrame:
    """Each key once within the watermark delay, however often it arrives."""
    return watermarked(alerts, delay).dropDuplicatesWithinWatermark([key])


def append_new_alerts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append alerts not yet in the table at ``path``; safe to restart and to replay.

    Alerts with a time are stored by day, and a batch is compared with the days it holds alone, since equal keys
    have equal times. A batch first lands in a scratch table, which goes when it is appended: the
    anti join reads the very table the batch is appended to.
    """
    by_day = "changed_at" in stream.columns

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        try:
            history = spark.read.parquet(path).filter(F.col("ingest_batch") != batch_id)
            if by_day:
                days = batch.agg(F.to_date(F.min("changed_at")).alias("low"), F.to_date(F.max("changed_at")).alias("high")).first()
                history = history.filter(F.col("alert_date").between(days["low"], days["high"]))
            history = history.select(*schema.fieldNames())
        except AnalysisException:  # first batch: no table yet
            history = batch.limit(0)
        landed = scratch_path(spark, "alerts")
        new_alerts(batch, history).write.parquet(landed)
        rows = spark.read.schema(schema).parquet(landed)
        target = f"{path}/ingest_batch={batch_id}"
        if by_day:
            rows.withColumn("alert_date", F.to_date("changed_at")).write.mode("overwrite").partitionBy("alert_date").parquet(target)
        else:
            rows.write.mode("overwrite").parquet(target)
        drop_path(spark, landed)

    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

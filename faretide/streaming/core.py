"""Starting and finishing streams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretide.session import scratch_path


def watermarked(stream: DataFrame, delay: str) -> DataFrame:
    """Stream with ``observed_at`` as its event time; later rows than ``delay`` are dropped."""
    return stream.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark(
        "observed_at", delay
    )


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what is started inside; a stream keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_available(
    stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None
) -> None:
    """Process everything available now into a Parquet table, then stop.

    The file sink commits each micro-batch once, so a restarted stream neither
    loses nor repeats rows.
    """
    writer = stream.writeStream.format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def result_of(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a finite stream to its end in a fresh scratch folder and read its output table."""
    root = scratch_path(spark, label)
    write_available(stream, f"{root}/out", f"{root}/state")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")

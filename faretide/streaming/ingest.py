"""Files of observations into the append-only table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretide.session import drop_path
from faretide.sources.observations import FILE, observations_of, scan_once
from faretide.streaming.core import write_available

# Sequence numbers of one micro-batch.
_BATCH_STRIDE = 1 << 43


def ingest_files(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    dataset: str,
    naive_tz: str = "UTC",
    max_files_per_trigger: int | None = None,
) -> None:
    """Append all new CSV files under ``source`` to the observation table at ``path``.

    Each file is read by its own header, as ``read_observations`` does, so older files and lines with
    surplus fields are treated alike in both. A batch is written under its own ``ingest_batch``
    folder and overwrites only that folder, so a batch repeated after a failure leaves no duplicates.

    The stream itself lists files and reads nothing of them. A batch's files are parsed once, into a scratch table
    that goes when the batch is written.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def append(batch: DataFrame, batch_id: int) -> None:
        # One name per new file; the batch always holds whole files.
        scanned = scan_once(spark, sorted(r["path"] for r in batch.collect()))
        if scanned is None:
            return
        rows, where = scanned
        (
            observations_of(rows, dataset, naive_tz, batch_id * _BATCH_STRIDE)
            .withColumn("ingest_batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("ingest_batch", "dataset", "obs_date")
            .parquet(path)
        )
        drop_path(spark, where)

    query = (
        reader.load(source)
        .select("path")
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream of canonical observations to the partitioned table."""
    dated = stream.withColumn("obs_date", F.to_date("observed_at"))
    write_available(dated, path, checkpoint, ["dataset", "obs_date"])

"""Alert history: two JSON layouts in, an append-only table out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretide.functions.text import first_filled
from faretide.operators.alerts import new_alerts
from faretide.schema import ALERT, RAW_ALERT


def read_raw_alerts(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Alert documents, either a bare array or ``{"alerts": [...]}``, one row per alert.

    ``multiline=False`` reads one document per line, which splits large files.
    """
    layout = T.StructType([*RAW_ALERT.fields, T.StructField("alerts", T.ArrayType(RAW_ALERT))])
    try:
        docs = spark.read.schema(layout).option("multiLine", multiline).json(path)
    except AnalysisException:
        return spark.createDataFrame([], RAW_ALERT)
    wrapped = docs.select(F.explode("alerts").alias("a")).select("a.*")
    filled = [F.col(c).isNotNull() for c in RAW_ALERT.fieldNames()]
    bare = docs.filter(F.col("alerts").isNull() & F.greatest(*[f.cast("int") for f in filled]).cast("boolean"))
    return bare.select(*RAW_ALERT.fieldNames()).unionByName(wrapped)


def canonical_alerts(raw: DataFrame) -> DataFrame:
    """Older field names folded into the current ones."""
    return raw.select(
        first_filled(F.col("hotel_name"), F.col("hotel")).alias("hotel_name"),
        F.coalesce("old_price", "from", "previous_price").alias("old_price"),
        F.coalesce("new_price", "to", "current_price").alias("new_price"),
        "price_change",
        "price_change_pct",
        first_filled(F.col("timestamp"), F.col("time")).alias("timestamp"),
        first_filled(F.col("alert_type"), F.col("type")).alias("alert_type"),
        "created_at",
        "threshold_percent",
        "unique_key",
        first_filled(F.col("message"), F.col("note")).alias("note"),
    )


def read_alerts(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return canonical_alerts(read_raw_alerts(spark, path, multiline))


def read_alert_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ALERT).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ALERT)


def append_alerts(candidates: DataFrame, path: str) -> None:
    """Append the candidates whose key is not in the table yet."""
    history = read_alert_table(candidates.sparkSession, path)
    typed = candidates.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in candidates.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in ALERT.fields
        ]
    )
    new_alerts(typed, history).write.mode("append").parquet(path)

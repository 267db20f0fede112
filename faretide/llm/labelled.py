"""Labelled samples of a corpus, bounded, with held-out rows left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of all documents, by checksum of the id; their labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, label`` of at most ``most`` labelled rows outside the held-out fifth, chosen by hash of the id.

    Rows without id or label are left out. Of several labels of one document the greatest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def plain_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

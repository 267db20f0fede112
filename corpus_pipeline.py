"""Corpus preparation in stages: each takes what the one before kept.

Low-quality documents go, one document of each near-duplicate group stays, passages that occur
earlier are cut out, documents that hold benchmark items go, and the rest is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretide.llm.decontaminate import contaminated
from faretide.llm.frames import free, keep
from faretide.llm.near_dedup import near_duplicates
from faretide.llm.packing import pack_documents
from faretide.llm.quality import fit_quality, score_quality
from faretide.llm.substring import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Shortest passage, in words, that is cut out where it repeats. A passage of over 50 words holds such windows.
PASSAGE_WORDS = 50


def _rejoin(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The documents with (left_semi) or without (left_anti) these ids; texts move once, at any size."""
    return docs.select(*COLUMNS).hint("merge").join(ids.select("doc_id"), "doc_id", how).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; documents without id cannot be judged and stay."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = score_quality(docs, model).filter("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return _rejoin(docs, rejected, "left_anti")


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: five-word shingles, 0.8.

    Rows that repeat both id and text count once; documents without id stay.
    """
    dropped = near_duplicates(docs, shingle=5, percent=80).filter("not kept")
    return _rejoin(docs, dropped, "left_anti").dropDuplicates(["doc_id", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier elsewhere. An untouched text stays as it is; an emptied one goes."""
    cut = remove_repeats(docs, PASSAGE_WORDS, columns=("lang", "source", "n_chars"), rejoin=False)
    return cut.filter("n_removed = 0 or n_removed < n_words").select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _rejoin(docs, found.select("doc_id").distinct(), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", near_unique),
    ("substring removal", without_repeats),
    ("decontamination", decontaminated),
    ("best-fit packing", packed),
]
# The first stage is a learnt model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            free(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query per operator over its whole table, and SQL twins where SQL can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from faretide.llm import chat, decontaminate
from faretide.llm.conversation_repair import damaged, repair_reports
from faretide.llm.fingerprint import edit_likeness
from faretide.llm.graph_search import build_index, nearest
from faretide.llm.near_dedup import near_duplicates
from faretide.llm.packing import pack_documents
from faretide.llm.periodic import echoed, periodic_runs, run_digests
from faretide.llm.quality import fit_quality, score_quality
from faretide.llm.substring import remove_repeats
from faretide.llm.token_files import read_token_files, write_token_files
from faretide.llm.toxicity import fit_toxicity, score_toxicity
from faretide.llm.warc import page_records, write_archives
from faretide.session import scratch_path

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_classifier")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@register("op2_document_fingerprints")
def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edit_likeness(table(spark, sf_dir, "documents"))


@register("op3_best_fit_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 byte-level tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op4_token_files")
def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files, and read back from them."""
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder)


@register("op5_chat_perspectives", chat.SQL)
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from the perspective of every participant; spans as text "start:end ..."."""
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), " ")
    return out.withColumn("spans", spans)


@register("op6_decontamination", decontaminate.SQL)
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items they hold."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_warc", """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND first < page_id THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
""")
def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files, and read back from them."""
    folder = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder).count()
    return page_records(spark, folder)


@register("op8_minhash_near_dedup")
def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@register("op9_substring_dedup")
def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 20-word windows starting earlier elsewhere cover, removed from all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op10_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@register("op11_periodic_runs")
def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which echo some of their words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(periodic_runs(docs.withColumn("text", echoed(F.col("doc_id"), F.col("text")))))


@register("op12_conversation_repair")
def _conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by checksum, with their faults and cheapest repairs."""
    return repair_reports(damaged(table(spark, sf_dir, "conversations")))


@register("op13_nearest_neighbours")
def _nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for every hundredth id."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(build_index(vectors, 10), vectors.filter("vec_id % 100 = 0"), 10)

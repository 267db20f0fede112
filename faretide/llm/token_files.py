"""Token ids in files: frequency ranks in one to four bytes, their widths in separate control bytes.

The ids of a corpus are ranked by frequency, so frequent ids need one byte. A file holds a run
of documents in ascending doc_id order:

    magic "FTID", then little-endian: documents u32, tokens u64, data bytes u64
    doc_id i64 per document, 1 byte per document (0: without doc_id), tokens u32 per document
    control bytes: 2 bits per token (width - 1), four tokens to a byte, the first in the lowest bits
    data bytes: the ranks, each in as few little-endian bytes as it needs

File names ascend with the order of documents. ``ranks.bin`` beside them holds the id of every rank as u32.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide.llm.frames import free, keep
from faretide.llm.tokens import encoder, text_slices, with_end

MAGIC = b"FTID"
# A file is closed when it holds this many tokens.
FILE_TOKENS = 2_000_000

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
# Width of each of the four values of a control byte, and of all four.
_WIDTHS = (_CODES + 1).astype(np.int64)
_TOTAL = _WIDTHS.sum(axis=1)
# Which data byte each of the 16 result bytes comes from; -1: none, the byte is zero.
_BYTE = np.arange(4)
_FROM = np.where(
    _BYTE < _WIDTHS[:, :, None], (np.cumsum(_WIDTHS, axis=1) - _WIDTHS)[:, :, None] + _BYTE, -1
).reshape(256, 16)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[_BYTE <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values; each control byte looks up where the bytes of its four values stand."""
    out = np.empty((len(control), 16), np.uint8)
    control = np.frombuffer(control, np.uint8)
    # Data bytes after the last value stand for the padding of the last control byte.
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)])
    at = np.cumsum(_TOTAL[control]) - _TOTAL[control]
    for a in range(0, len(control), 1 << 16):
        source = _FROM[control[a : a + (1 << 16)]]
        out[a : a + (1 << 16)] = np.where(source < 0, 0, data[source + at[a : a + (1 << 16), None]])
    return out.view("<u4").ravel()[:n]


def pack_file(doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    head = MAGIC + struct.pack("<IQQ", len(lengths), len(ranks), len(data))
    return b"".join(
        [head, doc_ids.astype("<i8").tobytes(), has_id.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), control, data]
    )


def unpack_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, size = struct.unpack_from("<IQQ", content, 4)
    at = 24
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    has_id = np.frombuffer(content, np.uint8, docs, at + 8 * docs).astype(bool)
    lengths = np.frombuffer(content, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    middle = at + -(-tokens // 4)
    if len(content) != middle + size:
        raise ValueError("token file is cut off")
    return doc_ids, has_id, lengths, decode_values(content[at:middle], content[middle:], tokens)


def _shards(path: str, end_id: int, file_tokens: int):
    """Sorted batches of (doc_id, text) -> one row per run of documents with the plain ids."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
        kind = np.uint16 if encode.size <= 1 << 16 else np.uint32
        docs, lengths, ids, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            has_id = np.array([d is not None for d in docs], np.uint8)
            numbers = np.array([d or 0 for d in docs], np.int64)
            values = np.concatenate(ids).astype(kind)
            columns = [[part], [number], [numbers.tobytes()], [has_id.tobytes()], [np.array(lengths, np.uint32).tobytes()], [values.tobytes()]]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["part", "number", "doc_ids", "has_id", "lengths", "ids"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in text_slices(batch.column(1)):
                values, bounds = with_end(*encode(texts), end_id)
                values, done, rows = values.astype(kind), 0, len(bounds) - 1
                while done < rows:
                    # Up to the row that fills the file.
                    full = int(np.searchsorted(bounds, bounds[done] + file_tokens - size))
                    last = min(full, rows)
                    docs += names[first + done : first + last]
                    lengths += np.diff(bounds[done : last + 1]).tolist()
                    ids.append(values[bounds[done] : bounds[last]])
                    size += int(bounds[last] - bounds[done])
                    done = last
                    if size >= file_tokens:
                        yield row()
                        docs, lengths, ids, size, number = [], [], [], 0, number + 1
        if docs:
            yield row()

    return build, "part int, number int, doc_ids binary, has_id binary, lengths binary, ids binary"


def _count_ids(size: int):
    """Batches of ids -> how often each id occurs in the task."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return build


def put(uri: str, content: bytes) -> None:
    """Write a file whole: under a name of its own first, so that a lost or repeated task leaves no part of one."""
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    context = TaskContext.get()
    draft = f"{path}.{context.taskAttemptId() if context else 'driver'}.tmp"
    with where.open_output_stream(draft) as f:
        f.write(content)
    where.move(draft, path)


def _write(folder: str, rank_of: np.ndarray):
    """Rows of ``_shards`` -> files; one row per file."""
    kind = np.uint16 if len(rank_of) <= 1 << 16 else np.uint32

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                name = f"part-{r['part']:09d}-{r['number']:09d}.ids"
                ranks = rank_of[np.frombuffer(r["ids"], kind)]
                content = pack_file(
                    np.frombuffer(r["doc_ids"], np.int64),
                    np.frombuffer(r["has_id"], np.uint8),
                    np.frombuffer(r["lengths"], np.uint32),
                    ranks,
                )
                put(f"{folder}/{name}", content)
                done.append({"file": name, "n_tokens": len(ranks), "bytes": len(content)})
            yield pa.RecordBatch.from_pylist(
                done, pa.schema([("file", pa.string()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])
            )

    return build


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` to ``folder``; gives ``file, n_tokens, bytes`` per file.

    ``folder`` is new and on storage that all executors share. Each row is a document, also where doc_id
    is repeated or null (those come first). Null texts count as empty and hold the end id alone. An
    empty table gives ``ranks.bin`` alone. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    build, schema = _shards(tokenizer, end_id, file_tokens)
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = keep(ordered.mapInArrow(build, schema), "ids")
    free(spark)
    size = encoder(tokenizer).size
    counts = shards.select("ids").mapInArrow(_count_ids(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    often = np.zeros(size, np.int64)
    for r in counts.collect():  # as many rows as the vocabulary has ids
        often[r["id"]] = r["n"]
    order = np.lexsort((np.arange(size), -often)).astype("<u4")
    rank_of = np.empty(size, "<u4")
    rank_of[order] = np.arange(size)
    put(f"{folder}/ranks.bin", order.tobytes())
    files = keep(shards.mapInArrow(_write(folder, rank_of), "file string, n_tokens long, bytes long"), "files")
    free(spark, shards)
    return files


def _read(order: np.ndarray, with_ids: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                doc_ids, has_id, lengths, ranks = unpack_file(content.as_buffer().to_pybytes())
                ids = order[ranks]
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                name = os.path.basename(path.as_py())
                columns = [
                    pa.array([name] * len(parts), pa.string()),
                    pa.array(doc_ids, mask=~has_id),
                    pa.array(ends - lengths),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["file", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return build


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of every document in the files of a folder.

    ``start`` counts the ids of all documents before it. ``ids`` are little-endian unsigned 32-bit integers.
    """
    where, path = fs.FileSystem.from_uri(f"{folder}/ranks.bin")
    with where.open_input_file(path) as f:
        order = np.frombuffer(f.read(), "<u4")
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids")
    rows = files.load(folder).select("path", "content").mapInArrow(_read(order, with_ids), schema)
    stored = keep(rows, "read")
    # One row per file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return stored.join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )

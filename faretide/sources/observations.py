"""Observation files and the append-only observation table."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretide import fixed_values as fv
from faretide.functions.money import finite
from faretide.functions.text import first_filled, nights_range, trip_dates
from faretide.functions.timestamps import normalize_ts, obs_day
from faretide.functions.urls import airport_name, departure_from_url
from faretide.plans.shape import attach, pin
from faretide.schema import OBSERVATION
from faretide.session import scratch_path

_OVERFLOW = "_overflow"
_FILE, _BLOCK, _ROW = "_file", "_block", "_row"
# What Spark lists of a file.
FILE = "path string, modificationTime timestamp, length long, content binary"
# First lines are read in pieces of this many bytes, then twice as many and so on.
_PIECE = 1 << 14


def empty_observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBSERVATION)


def _names(line: str) -> list[str]:
    """Column names of a header line."""
    return [name.strip() for name in next(csv.reader([line])) if name.strip()]


def _open(path: str):
    """A file of the listing, opened where the task runs; raises where Arrow has no access to its storage."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(unquote(inner))


def _first_line(path: str) -> str:
    """First line of a file that is not blank; the file is read up to its end in growing pieces."""
    with _open(path) as file:
        held, size = b"", _PIECE
        while True:
            piece = file.read(size)
            held, size = held + piece, 2 * size
            for line in held.splitlines(keepends=True):
                if line.strip() and (not piece or line.endswith((b"\n", b"\r"))):
                    return line.decode("utf-8", "replace").rstrip("\r\n")
            if not piece:
                return ""


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for path in batch.column(0).to_pylist():
            try:
                lines.append(_first_line(path))
            except (pa.ArrowException, OSError, ImportError):
                lines.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["path", "line"])


def listed_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """``path`` of every file under ``paths``, from Spark's own listing; no content is read. None: a path is missing."""
    try:
        return spark.read.format("binaryFile").schema(FILE).load(list(paths)).select("path")
    except AnalysisException:
        return None


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files under ``paths`` by their first line; missing and empty ones are left out.

    Tasks read the first lines of the listed files, a few kilobytes of each. One row per file reaches the driver, as
    in any listing of files. Storage that only Spark's readers can open is read by them up to its first line.
    """
    if not paths:
        return {}
    files = listed_files(spark, paths)
    if files is None:
        if len(paths) == 1:
            return {}
        found: dict[str, list[str]] = {}
        for path in paths:
            for line, some in _headers(spark, [path]).items():
                found.setdefault(line, []).extend(f for f in some if f not in found.get(line, []))
        return found
    found = {}
    for path, line in sorted(map(tuple, files.mapInArrow(_heads, "path string, line string").collect())):
        if line is None:
            # A limit stops the reader after its first buffer.
            first = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
            line = first["value"] if first else ""
        if line.lstrip("\ufeff"):
            found.setdefault(line.lstrip("\ufeff"), []).append(path)
    return found


def _read_group(spark: SparkSession, header: list[str], files: list[str], multiline: bool) -> DataFrame:
    """Files with one header."""
    fields = [T.StructField(name, T.StringType()) for name in [*header, _OVERFLOW]]
    raw = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multiline)
        .csv(files)
    )
    known = [c for c in [*fv.OBSERVATION_COLUMNS, fv.OPTIONAL_AIRPORT_COLUMN] if c in header]
    # A row with a surplus field is malformed and skipped; a short row is padded with nulls.
    return raw.filter(F.col(_OVERFLOW).isNull()).select(
        *known,
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ROW),
    )


def _numbered(rows: DataFrame, seq_start: int) -> DataFrame:
    """Add ``seq`` by file path, block and line to stored rows. Only one row per file block is ordered."""
    blocks = rows.groupBy(_FILE, _BLOCK).agg(F.min(_ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(_FILE, _BLOCK, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    seq = F.col("_before") + F.col(_ROW) - F.col("_first") + F.lit(seq_start)
    numbered = attach(rows, starts, [_FILE, _BLOCK], "inner").withColumn("seq", seq)
    return numbered.drop(_FILE, _BLOCK, _ROW, "_first", "_before")


def scan_once(
    spark: SparkSession, paths: Sequence[str], multiline: bool = False
) -> tuple[DataFrame, str] | None:
    """The rows of all files as text columns, with their file, block and place, parsed once into a scratch table.

    Returns the table and its folder, or None if the files have no columns. The files are not read again: line numbers, and
    whatever follows, come from the table.
    """
    groups = _headers(spark, list(paths))
    parts = [_read_group(spark, _names(line), files, multiline) for line, files in groups.items() if _names(line)]
    if not parts:
        return None
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    where = scratch_path(spark, "scan")
    raw.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(raw.schema).parquet(where), where


def read_observations(
    spark: SparkSession,
    paths: str | Sequence[str],
    dataset: str,
    naive_tz: str = "UTC",
    seq_start: int = 0,
    multiline: bool = False,
) -> DataFrame:
    """Observation CSVs as the canonical table.

    Columns are matched by the header of each file, so older files with fewer
    or reordered columns can stand in the same folder; columns that all files lack become
    empty text. A price that is no finite number is missing. Rows without a valid time are dropped. ``seq`` counts from ``seq_start`` by file path and
    line (see ``next_seq``) and is kept by ``append_observations``; a path that does not exist
    or holds nothing contributes no rows. The files are parsed here, once (see ``scan_once``); the result reads a scratch table. ``multiline`` allows line breaks in
    quoted fields, at the price of one task per file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    scanned = scan_once(spark, paths, multiline)
    if scanned is None:
        return empty_observations(spark)
    return observations_of(scanned[0], dataset, naive_tz, seq_start)


def observations_of(rows: DataFrame, dataset: str, naive_tz: str = "UTC", seq_start: int = 0) -> DataFrame:
    """The canonical table of rows of ``scan_once``."""
    return canonical(_numbered(rows, seq_start), dataset, naive_tz, seq_start)


def next_seq(spark: SparkSession, path: str) -> int:
    """The number after the greatest ``seq`` of a table: where the next read continues."""
    try:
        greatest = spark.read.parquet(path).agg(F.max("seq").alias("seq")).first()["seq"]
    except AnalysisException:
        return 0
    return 0 if greatest is None else greatest + 1


def canonical(raw: DataFrame, dataset: str, naive_tz: str = "UTC", seq_start: int = 0) -> DataFrame:
    """Text columns by name to the canonical observation table; rows without ``seq`` get increasing numbers."""
    lacking = [c for c in fv.OBSERVATION_COLUMNS if c not in raw.columns]
    text = raw.select("*", *[F.lit("").alias(c) for c in lacking])
    if fv.OPTIONAL_AIRPORT_COLUMN not in raw.columns:
        text = text.withColumn(fv.OPTIONAL_AIRPORT_COLUMN, F.lit(None).cast("string"))
    numbered = text
    if "seq" not in raw.columns:
        numbered = text.withColumn("seq", F.monotonically_increasing_id() + F.lit(seq_start))
    instant = normalize_ts(F.col("scraped_at"), naive_tz)
    return (
        numbered.withColumn("observed_at", instant)
        .filter(F.col("observed_at").isNotNull())
        .select(
            F.lit(dataset).alias("dataset"),
            "hotel_name",
            finite(F.col("price").try_cast("double")).alias("price"),
            *[c for c in fv.OBSERVATION_COLUMNS if c not in ("hotel_name", "price")],
            fv.OPTIONAL_AIRPORT_COLUMN,
            "observed_at",
            obs_day(F.col("observed_at")).alias("obs_date"),
            "seq",
        )
    )


def with_trip_facts(obs: DataFrame) -> DataFrame:
    """Add the typed facts of the text fields: trip days, range of nights, departure airport."""
    trip, nights = trip_dates(F.col("dates")), nights_range(F.col("duration"))
    given = [F.col(c) for c in (fv.OPTIONAL_AIRPORT_COLUMN,) if c in obs.columns]
    return obs.select(
        "*",
        trip["trip_start"].alias("trip_start"),
        trip["trip_end"].alias("trip_end"),
        nights["nights_min"].alias("nights_min"),
        nights["nights_max"].alias("nights_max"),
        first_filled(*given, airport_name(departure_from_url(F.col("url")))).alias("airport"),
    )


def append_observations(df: DataFrame, path: str) -> None:
    """Append every observation as a new point; nothing written before is touched.

    Rows are clustered by partition first, so one batch adds one file per
    (dataset, day) rather than one per task; AQE splits a large day again.
    """
    (
        df.hint("rebalance", "dataset", "obs_date")
        .write.mode("append")
        .partitionBy("dataset", "obs_date")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The observation table, pruned by dataset and day like any partitioned Parquet."""
    try:
        return spark.read.schema(OBSERVATION).parquet(path).select(*OBSERVATION.fieldNames())
    except AnalysisException:
        return empty_observations(spark)


def export_csv(df: DataFrame, path: str) -> None:
    """Write the observation columns in file order, every field quoted."""
    columns = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
        for c in fv.OBSERVATION_COLUMNS
    ]
    (
        df.select(*columns)
        .write.mode("errorifexists")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .csv(path)
    )


def retain(obs: DataFrame, days: int = fv.RETENTION_DAYS) -> DataFrame:
    """Observations of the last ``days`` days of every dataset, counted back from its newest day."""
    newest = pin(obs.groupBy("dataset").agg(F.max("obs_date").alias("_newest")))
    # The earliest edge of all prunes partitions, the edge of each dataset decides.
    earliest = newest.agg(F.date_sub(F.min("_newest"), days)).scalar()
    kept = obs.filter(F.col("obs_date") >= earliest).join(newest, "dataset")
    return kept.filter(F.col("obs_date") >= F.date_sub("_newest", days)).select(*obs.columns)


def union_datasets(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """All datasets in one table, told apart by ``dataset``."""
    named = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)

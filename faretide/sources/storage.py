"""Storage of the observation table: days that are too old go, small files of closed days become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretide import fixed_values as fv
from faretide.schema import OBSERVATION
from faretide.session import drop_path, scratch_path

# Folders that one job rewrites.
FOLDERS_PER_JOB = 500


def day_folders(spark: SparkSession, path: str) -> DataFrame:
    """``folder, day, newest, files, bytes`` of every (dataset, day) of the table; ``newest`` is the dataset's last day.

    Files are listed, not read. Rows without a day have a folder without one, which is left out here and therefore kept.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folders = files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    dated = folders.withColumn("day", F.regexp_extract("folder", r"/obs_date=([^/]*)$", 1).try_cast("date"))
    of_dataset = Window.partitionBy(F.regexp_extract("folder", r"^(.*)/[^/]*$", 1))
    return dated.filter("day is not null").select(
        "folder", "day", F.max("day").over(of_dataset).alias("newest"), "files", "bytes"
    )


def _table_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_old_days(spark: SparkSession, path: str, days: int = fv.RETENTION_DAYS) -> int:
    """Delete the folders of all days before the last ``days`` of their dataset; gives how many went.

    What is left equals ``retain`` of the table before. A table that does not exist has nothing to drop.
    """
    if not _table_exists(spark, path):
        return 0
    old = day_folders(spark, path).filter(F.col("day") < F.date_sub("newest", days)).select("folder")
    dropped = 0
    for r in old.toLocalIterator():  # one row per day that goes
        drop_path(spark, r["folder"])
        dropped += 1
    return dropped


def compact_days(spark: SparkSession, path: str, files: int = 2) -> int:
    """Rewrite days before the newest of their dataset that are held in at least ``files`` files; gives how many.

    Rows stay the same. They are copied to a scratch table first and then replace their folders, so a failed call
    leaves every row in one of both. A large day keeps several files, and is rewritten only if
    they are smaller than a quarter of Spark's advisory partition size on average. No other job may write to these days meanwhile.
    """
    if not _table_exists(spark, path):
        return 0
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    )
    many = (F.col("files") >= files) & (F.col("files") > F.ceil(4 * F.col("bytes") / size))
    chosen = day_folders(spark, path).filter((F.col("day") < F.col("newest")) & many).select("folder").orderBy("folder")
    folders = [r["folder"] for r in chosen.collect()]  # one row per day
    for a in range(0, len(folders), FOLDERS_PER_JOB):
        rows = spark.read.schema(OBSERVATION).option("basePath", path).parquet(*folders[a : a + FOLDERS_PER_JOB])
        scratch = scratch_path(spark, "compacted")
        rows.write.parquet(scratch)
        (
            spark.read.schema(rows.schema)
            .parquet(scratch)
            .hint("rebalance", "dataset", "obs_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dataset", "obs_date")
            .parquet(path)
        )
        drop_path(spark, scratch)
    return len(folders)

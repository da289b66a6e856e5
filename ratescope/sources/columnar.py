"""Parquet tables partitioned by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.functions import row_bytes, row_hash


#: Bytes of uncompressed values that one file of a period holds.
BYTES_PER_FILE = 1 << 30


def clustered(df: DataFrame, period: str, bytes_per_file: int = BYTES_PER_FILE) -> DataFrame:
    """The rows dealt so that each task holds rows of one period, about ``bytes_per_file`` of them at most.

    A first scan adds up the bytes per period, one number per folder to be written. A period is dealt to as many tasks
    as its bytes ask for, by the hash of the whole row, which gives the same place when a lost task runs again. Exact copies
    of one row therefore stay together.
    """
    names = df.columns
    sizes = df.groupBy(period).agg(F.sum(row_bytes(df, names)).alias("bytes")).collect()
    plan, tasks = [], 0
    for row in sizes:
        files = max(1, -(-row["bytes"] // bytes_per_file))
        plan.append((row[period], tasks, files))
        tasks += files
    if not plan:
        return df
    fields = [T.StructField("_key", df.schema[period].dataType), T.StructField("_first", T.LongType()), T.StructField("_files", T.LongType())]
    places = F.broadcast(df.sparkSession.createDataFrame(plan, T.StructType(fields)))
    slot = F.col("_first") + F.pmod(row_hash(df, names), F.col("_files"))
    return (
        df.join(places, F.col(period).eqNullSafe(F.col("_key")))
        .withColumn("_slot", slot.cast("int"))
        .repartitionById(tasks, "_slot")
        .select(*names)
    )


def write_columnar(
    df: DataFrame,
    path: str,
    period: str | None = None,
    mode: str = "errorifexists",
    bytes_per_file: int = BYTES_PER_FILE,
) -> None:
    """Parquet with zstd; one folder per period so that period filters prune whole folders.

    How many files a period has follows from its bytes, whatever tasks its rows come from.
    """
    if period is not None:
        df = clustered(df, period, bytes_per_file)
    writer = df.write.mode(mode).option("compression", "zstd")
    if period is not None:
        writer = writer.partitionBy(period)
    writer.parquet(path)


def read_columnar(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The table with its columns in the given order (a partition column is stored last)."""
    return spark.read.parquet(path).select(*columns)


def scan_period(
    spark: SparkSession,
    path: str,
    periods: Sequence[int],
    columns: Sequence[str],
    period: str = "period",
) -> DataFrame:
    """Only the given periods and columns; folders of other periods are not opened."""
    return spark.read.parquet(path).where(F.col(period).isin(*periods)).select(*columns)


def scan_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the given columns; the others are never decoded."""
    return spark.read.parquet(path).select(*columns)

"""What the corpus operators share: reading tables, row numbers, hashing and ranks without one big task."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratescope.runtime import settle

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The session's limit for Arrow batches; 64 MB by Spark's own default.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort; for numbers several times faster than ``np.unique``."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def in_pieces(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most_bytes`` of text in a column; a longer text is alone.

    What a worker makes from a piece is then bounded by bytes, not by the number of rows in a batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(ends):
            before = int(ends[row - 1]) if row else 0
            upto = max(row + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(row, upto - row)
            row = upto
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Let Arrow batches on the way to Python hold at most so many bytes (a longer row is alone), unless the session has a limit of its own."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, str(most_bytes))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_numbers(df: DataFrame, written: bool = False) -> tuple[DataFrame, str]:
    """``df`` with a number of its own for every row, and that column's name.

    Later jobs and repeated tasks all see the same number. It tells rows apart whose ids are null or
    repeated. By default it is written with a copy of the rows. ``written`` says that ``df`` is a Parquet table as
    read, so that each row of its files is one row: the number is then made of the file, counted
    in order of the paths, and the row's place in it, and nothing is copied.
    """
    name = unused_name(df, "row")
    if not written:
        return settle(df.withColumn(name, F.monotonically_increasing_id())), name
    about, path, file = df.metadataColumn("_metadata"), unused_name(df, f"{name}_path"), unused_name(df, f"{name}_file")
    paths = sorted(r[0] for r in df.select(about["file_path"]).distinct().collect())
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), f"{file} long, {path} string")
    placed = df.select("*", about["file_path"].alias(path), about["row_index"].alias(name))
    number = F.shiftleft(file, 40) + F.col(name)
    return placed.join(F.broadcast(files), path).withColumn(name, number).select(*df.columns, name), name


def ranks_within(df: DataFrame, keys: list[str], order: list[str], name: str, split: Column, parts: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, as column ``name``.

    A key's rows are dealt over ``parts`` parts by ``split``; each part is numbered by itself and the
    sizes of the parts before it are added. So no task sorts more than one part of a key, and the
    only table that is gathered per key has one row per part. ``df`` must be settled: it is read
    twice and both readings have to agree. The order of rows follows the part, then ``order``.
    """
    dealt = df.withColumn("part_", F.pmod(split, F.lit(parts)))
    sizes = dealt.groupBy(*keys, "part_").agg(F.count(F.lit(1)).alias("size_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"{k}_k") for k in keys],
        F.col("part_").alias("part_k"),
        F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("start_"),
    )
    within = Window.partitionBy(*keys, "part_").orderBy(*order)
    numbered = dealt.withColumn("number_", F.row_number().over(within) - 1)
    same = F.col("part_") == F.col("part_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    return (
        numbered.join(starts, same)
        .withColumn(name, (F.col("start_") + F.col("number_")).cast("long"))
        .drop("part_", "number_", "part_k", "start_", *[f"{k}_k" for k in keys])
    )


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Left join of ``rows`` with one row of ``values`` per key, for keys that may hold most rows.

    The values first meet the (key, part) pairs that occur, then rows join on key and part; a key's rows
    are then as many groups as it has parts. Rows must be settled: they are read twice.
    """
    pairs = rows.select(*keys, part).distinct()
    return rows.join(pairs.join(values, keys), [*keys, part], "left")

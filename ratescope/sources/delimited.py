"""Delimited text with a fixed header, and the typing step that follows it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.functions import any_positive, clean_text, comma_decimal

# Text read as NULL.
NULL_TOKENS = ("", "NA", "N/A")


def read_delimited_strict(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    separator: str = ";",
    encoding: str = "windows-1252",
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """All columns as text; a different header or a ragged row fails the read.

    Windows code pages are outside the charsets Spark accepts by default, so for those the session
    needs ``spark.sql.legacy.javaCharsets=true``; the reader asks for it instead of changing it.
    """
    known = {"us-ascii", "iso-8859-1", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32"}
    if encoding.lower() not in known:
        if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
            raise ValueError(f"{encoding} needs spark.sql.legacy.javaCharsets=true")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("header", True)
        .option("encoding", encoding)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)  # else rows are checked only as far as they are read
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    return raw.select(
        *[F.when(F.col(c).isin(*null_tokens), None).otherwise(F.col(c)).alias(c) for c in columns]
    )


def standardize_types(
    df: DataFrame,
    period: int | str,
    period_column: str = "period",
    text: Sequence[str] = (),
    dates: Sequence[str] = (),
    times: Sequence[str] = (),
    integers: Sequence[str] = (),
    lenient_integers: Sequence[str] = (),
    decimals: Sequence[str] = (),
    flag_counts: Sequence[str] = (),
    flag_column: str = "flag",
) -> DataFrame:
    """Type every column in one projection.

    Dates, times and integers are strict (a bad value fails the query), decimals use a comma and
    are lenient like ``lenient_integers``. ``period`` is a value or the name of a column.
    """

    def strict_time(name: str):
        return F.date_format(F.to_timestamp(F.col(name), "HH:mm:ss"), "HH:mm:ss")

    rules = {}
    for name in text:
        rules[name] = clean_text(name)
    for name in dates:
        rules[name] = F.to_date(F.col(name), "yyyy-MM-dd")
    for name in times:
        rules[name] = strict_time(name)
    for name in integers:
        rules[name] = F.trim(F.col(name)).cast("bigint")
    for name in lenient_integers:
        rules[name] = F.trim(F.col(name)).try_cast("bigint")
    for name in decimals:
        rules[name] = comma_decimal(name)
    value = F.col(period) if isinstance(period, str) else F.lit(period)
    typed = df.select(
        *[rules.get(c, F.col(c)).alias(c) for c in df.columns if c != period_column],
        value.cast("int").alias(period_column),
    )
    if not flag_counts:
        return typed
    return typed.withColumn(flag_column, any_positive(*flag_counts))


def union_periods(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack one table per period by column name."""
    if not frames:
        raise ValueError("no table to stack")
    return reduce(DataFrame.unionByName, frames)


def read_periods(
    spark: SparkSession,
    files: Mapping[int, str],
    columns: Sequence[str],
    period_column: str = "period",
    **types,
) -> DataFrame:
    """One file (or folder) per period, read strictly, typed and stacked."""
    reader = {k: types.pop(k) for k in ("separator", "encoding", "null_tokens") if k in types}
    return union_periods(
        [
            standardize_types(
                read_delimited_strict(spark, path, columns, **reader),
                period,
                period_column,
                **types,
            )
            for period, path in sorted(files.items())
        ]
    )

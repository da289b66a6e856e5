"""Result tables as CSV and cube rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def finite_or_error(df: DataFrame) -> DataFrame:
    """The same rows; a NaN or infinite number fails the query that reads it."""
    checked = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            message = F.lit(f"{field.name} is not finite")
            c = F.when(bad, F.raise_error(message)).otherwise(c)
        checked.append(c.alias(field.name))
    return df.select(*checked)


def write_cube_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines without NaN or infinity; the check happens in the write itself."""
    finite_or_error(df).write.mode(mode).json(path)

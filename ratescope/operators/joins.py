"""Joins with the checks that Spark's join does not make, and set operations on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescope.functions import demand


def attach_attributes(df: DataFrame, attributes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; rows without attributes stay."""
    return df.join(attributes, list(keys), "left")


def _counted(df: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count), *[F.first(c).alias(c) for c in others]
    )


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with each key once; a second row of a key fails the query.

    The keys are grouped anyway for the join that follows, so the check costs no extra shuffle.
    """
    single = demand(F.col("_n") == 1, "key is not unique")
    return _counted(df, keys, "_n").where(single).drop("_n")


def lookup(
    df: DataFrame, key: str, mapping: Mapping | DataFrame, name: str, what: str = "value", default=None
) -> DataFrame:
    """``df`` with the mapped value of ``key`` as column ``name``; for mappings of any length.

    A key outside the mapping gets ``default``, or, without one, fails the query, whichever columns are read. A NULL key
    stays NULL. ``mapping`` is a dictionary, or a table of (key, value) with unique keys; a repeated key is an
    error. The mapping is a table that is joined, so a plan does not grow with it and Spark sends it to
    every task only if it is small. An empty dictionary needs a table to have types.
    """
    if isinstance(mapping, Mapping):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), ["_key", "_value"])
    table = mapping.toDF("_key", "_value").groupBy("_key").agg(F.first("_value").alias("_value"), F.count(F.lit(1)).alias("_n"))
    table = table.where(demand(F.col("_n") == 1, "key is not unique")).select("_key", "_value", F.lit(True).alias("_found"))
    joined = df.join(table, F.col(key) == F.col("_key"), "left")
    value = F.col("_value")
    if default is None:
        message = F.concat(F.lit(f"unmapped {what}: "), F.col(key).cast("string"))
        joined = joined.where(demand(F.col("_found").isNotNull() | F.col(key).isNull(), message))
    else:
        value = F.when(F.col("_found").isNull(), F.lit(default)).otherwise(value)
    kept = [c for c in df.columns if c != name]
    return joined.select(*kept, value.alias(name))


def checked_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", cardinality: str = "m:1"
) -> DataFrame:
    """Join whose right side (``m:1``) or both sides (``1:1``) hold each key once.

    The check reads the right side's row count after the join, so it also runs where no column of
    the right side is read; a duplicated right key fails the query if it meets a row of the left.
    """
    if cardinality not in ("m:1", "1:1"):
        raise ValueError(cardinality)
    if cardinality == "1:1":
        left = unique_keys(left, keys)
    if how.replace("_", "") in ("semi", "leftsemi", "anti", "leftanti"):
        return left.join(unique_keys(right, keys), list(keys), how)
    single = demand(F.coalesce("_n_right", F.lit(1)) == 1, "key is not unique")
    joined = left.join(_counted(right, keys, "_n_right"), list(keys), how)
    return joined.where(single).drop("_n_right")


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side that lacks them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("missing_from", F.lit("right")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("missing_from", F.lit("left"))
    )


def alignment_report(
    left: DataFrame, right: DataFrame, keys: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """One row: keys missing on either side and differing values per compared column."""
    keys = list(keys)

    def side(df, tag):
        return df.select(
            *keys, F.lit(True).alias(f"_{tag}"), *[F.col(c).alias(f"_{tag}_{c}") for c in compare]
        )

    both = F.col("_a") & F.col("_b")
    return (
        side(left, "a")
        .join(side(right, "b"), keys, "full_outer")
        .agg(
            F.count_if(F.col("_b").isNull()).alias("missing_from_right"),
            F.count_if(F.col("_a").isNull()).alias("missing_from_left"),
            F.count_if(F.coalesce(both, F.lit(False))).alias("matched"),
            *[
                F.count_if(
                    F.coalesce(both, F.lit(False))
                    & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
                ).alias(f"{c}_mismatches")
                for c in compare
            ],
        )
    )


def align_tables(
    left: DataFrame, right: DataFrame, keys: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """``left`` with the other columns of ``right``; any disagreement fails the query."""
    keys = list(keys)
    a = left.withColumn("_a", F.lit(True))
    extra = [c for c in right.columns if c not in keys and c not in compare]
    b = right.select(
        *keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in compare], *extra
    )
    joined = a.join(b, keys, "full_outer")
    agree = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in compare:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return joined.where(demand(agree, "tables disagree")).select(*left.columns, *extra)


def pair_deltas(
    df: DataFrame, name: str, pairs: Sequence[tuple[str, str]], measures: Sequence[str]
) -> DataFrame:
    """Difference b − a of the measures for the listed pairs of rows."""
    listed = df.sparkSession.createDataFrame(list(pairs), "a string, b string")
    a = df.select(F.col(name).alias("a"), *[F.col(m).alias(f"_a_{m}") for m in measures])
    b = df.select(F.col(name).alias("b"), *[F.col(m).alias(f"_b_{m}") for m in measures])
    return (
        listed.join(a, "a")
        .join(b, "b")
        .select(
            "a", "b", *[(F.col(f"_b_{m}") - F.col(f"_a_{m}")).alias(f"{m}_delta") for m in measures]
        )
    )


# --- set operations --------------------------------------------------------------------------


def union_strict(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack tables with the same columns and types."""
    head = parts[0].dtypes
    for other in parts[1:]:
        if sorted(other.dtypes) != sorted(head):
            raise ValueError("tables differ in columns or types")
    return reduce(DataFrame.unionByName, parts)


def union_relaxed(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by name; a column missing in one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def set_presence(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Every distinct value with 'both', 'left' or 'right'; one grouping instead of three joins."""
    tagged = left.select(column, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(column, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        tagged.groupBy(column)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .select(
            column,
            F.when(F.col("l") + F.col("r") == 2, "both")
            .when(F.col("l") == 1, "left")
            .otherwise("right")
            .alias("presence"),
        )
    )


def distinct_on(df: DataFrame, keys: Sequence[str], first_by: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes first in the order of ``first_by``."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*others)
    return (
        df.groupBy(*keys)
        .agg(F.min_by(row, F.struct(*first_by, *others)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )

"""When categories appear and disappear, and which rates are stable over periods.

All dimensions are put in long form and grouped once. The results are sums over those cells, and
each reader of the cells uses all their measures, so Spark plans the shuffle a single time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.functions import percent
from ratescope.operators.ranking import MINIMUM_ROWS
from ratescope.operators.rates import cell_total, dimension_cells

# Fixed value: periods a category needs before its spread is reported.
MINIMUM_PERIODS = 3


def _long(df: DataFrame, dimensions: Mapping[str, str], keep: list[str]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"), F.col(column).cast("string").alias("category")
            )
            for name, column in dimensions.items()
        ]
    )
    return df.select(*keep, F.inline(pairs))


def presence_cells(df: DataFrame, dimensions: Mapping[str, str], period: str) -> DataFrame:
    """(dimension, category, period, rows) of all dimensions from one scan."""
    return (
        _long(df, dimensions, [period])
        .groupBy("dimension", "category", period)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _present(period: str) -> Column:
    return F.when(F.col("rows") > 0, F.col(period))


def lifecycle_of(cells: DataFrame, period: str = "period") -> DataFrame:
    """First and last period, periods observed, volume and presence flags per category.

    Every row of the table has a category in each dimension, so all dimensions share one span.
    """
    span = cells.agg(
        F.struct(
            F.min(_present(period)).alias("first"),
            F.max(_present(period)).alias("last"),
            F.count_distinct(_present(period)).alias("periods"),
        )
    ).scalar()
    return (
        cells.groupBy("dimension", "category")
        .agg(
            F.min(period).alias("first_period"),
            F.max(period).alias("last_period"),
            F.count(F.lit(1)).alias("periods_observed"),
            F.sum("rows").alias("total"),
        )
        .withColumns(
            {
                "present_all_periods": F.col("periods_observed") == span["periods"],
                "only_one_period": F.col("periods_observed") == 1,
                "appears_later": F.col("first_period") > span["first"],
                "disappears_earlier": F.col("last_period") < span["last"],
            }
        )
    )


def category_lifecycle(
    df: DataFrame, dimensions: Mapping[str, str], period: str = "period"
) -> DataFrame:
    """``lifecycle_of`` for a table; ``dimensions`` maps a dimension name to its column."""
    return lifecycle_of(presence_cells(df, dimensions, period), period)


def taxonomy_diagnostics(
    df: DataFrame, dimensions: Mapping[str, str], period: str = "period"
) -> DataFrame:
    """Per dimension: categories, first-seen and last-seen counts per period, plus one overall row."""
    cells = presence_cells(df, dimensions, period)
    lifecycle = lifecycle_of(cells, period)
    observed = cells.groupBy("dimension", period).agg(
        F.count_if(F.col("rows") > 0).alias("distinct_categories")
    )
    ends = F.array(
        F.struct(F.col("first_period").alias(period), F.lit(1).alias("f"), F.lit(0).alias("l")),
        F.struct(F.col("last_period").alias(period), F.lit(0).alias("f"), F.lit(1).alias("l")),
    )
    edges = (
        lifecycle.where(F.col("total") > 0)
        .select("dimension", F.inline(ends))
        .groupBy("dimension", period)
        .agg(F.sum("f").alias("first_seen"), F.sum("l").alias("last_seen"))
    )
    per_period = observed.join(edges, ["dimension", period], "left").select(
        "dimension",
        F.lit("period").alias("scope"),
        period,
        "distinct_categories",
        F.coalesce("first_seen", F.lit(0)).alias("first_seen"),
        F.coalesce("last_seen", F.lit(0)).alias("last_seen"),
    )
    overall = (
        lifecycle.where(F.col("total") > 0)
        .groupBy("dimension")
        .agg(
            F.lit("overall").alias("scope"),
            F.count(F.lit(1)).alias("union_categories"),
            F.count_if("present_all_periods").alias("present_all_periods"),
            F.count_if("only_one_period").alias("only_one_period"),
            F.count_if("appears_later").alias("appears_later"),
            F.count_if("disappears_earlier").alias("disappears_earlier"),
        )
    )
    return per_period.unionByName(overall, allowMissingColumns=True)


def stability_filtered(
    df: DataFrame,
    dimensions: Mapping[str, str],
    flag: str = "flag",
    period: str = "period",
    minimum_periods: int = MINIMUM_PERIODS,
    minimum_rows: int = MINIMUM_ROWS,
) -> DataFrame:
    """Rate spread of categories seen often enough, with volume and a priority flag.

    Priority means seen in all periods and at least ``minimum_rows`` rows.
    """
    cells = dimension_cells(df, dimensions, flag, period)
    return stability_from_cells(cells, period, minimum_periods, minimum_rows)


def stability_from_cells(
    cells: DataFrame,
    period: str = "period",
    minimum_periods: int = MINIMUM_PERIODS,
    minimum_rows: int = MINIMUM_ROWS,
) -> DataFrame:
    """``stability_filtered`` of ``dimension_cells``."""
    periods = cells.agg(F.count_distinct(F.when(cell_total() > 0, F.col(period)))).scalar()
    low, high = F.min("rate_percent"), F.max("rate_percent")
    return (
        cells.withColumn("rate_percent", percent("flagged", cell_total()))
        .groupBy("dimension", "category")
        .agg(
            F.count(F.lit(1)).alias("periods_observed"),
            F.sum(cell_total()).alias("total"),
            low.alias("minimum_rate_percent"),
            high.alias("maximum_rate_percent"),
            F.round(high - low, 6).alias("range_points"),
        )
        .where(F.col("periods_observed") >= minimum_periods)
        .withColumn(
            "priority", (F.col("periods_observed") == periods) & (F.col("total") >= minimum_rows)
        )
    )

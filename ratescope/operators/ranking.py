"""Sorted and top-k views of summary tables.

``orderBy(...).limit(k)`` keeps k rows per task and merges them, so no full sort happens. Every
order ends with the category name, which makes equal values come out in a fixed order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import all_present
from ratescope.operators.rates import as_list, cell_total

# List length and minimum sample of a rate ranking.
RANKING_SIZE = 15
MINIMUM_ROWS = 500

_MEASURES = ("total", "flagged", "rate_percent")


def _without(summary: DataFrame, excluded: Mapping[str, Sequence]) -> DataFrame:
    for name, values in excluded.items():
        summary = summary.where(~F.col(name).isin(*values))
    return summary


def top_by_volume(
    summary: DataFrame,
    categories: str | Sequence[str],
    size: int = RANKING_SIZE,
    excluded: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    names = as_list(categories)
    return (
        _without(summary, excluded or {})
        .orderBy(F.desc("total"), *names)
        .limit(size)
        .select(*names, *_MEASURES)
    )


def top_by_rate(
    summary: DataFrame,
    categories: str | Sequence[str],
    minimum_rows: int = MINIMUM_ROWS,
    size: int = RANKING_SIZE,
    excluded: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    return rate_highlights(summary, categories, minimum_rows, excluded).limit(size)


def rate_highlights(
    summary: DataFrame,
    categories: str | Sequence[str],
    minimum_rows: int = MINIMUM_ROWS,
    excluded: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """All categories with a sufficient sample, highest rate first."""
    names = as_list(categories)
    return (
        _without(summary.where(F.col("total") >= minimum_rows), excluded or {})
        .select(*names, *_MEASURES)
        .orderBy(F.desc("rate_percent"), F.desc("total"), *names)
    )


def value_highlights(
    distribution: DataFrame, value: str, minimum_rows: int = MINIMUM_ROWS
) -> DataFrame:
    """Exact values with a sufficient sample, in value order."""
    return (
        distribution.where(F.col("total") >= minimum_rows)
        .select(value, *_MEASURES)
        .orderBy(value)
    )


def rate_extreme(summary: DataFrame, category: str) -> DataFrame:
    """Category with the highest and the lowest rate; equal rates go to the smaller name."""
    best = F.struct(-F.col("rate_percent"), F.col(category))
    worst = F.struct(F.col("rate_percent"), F.col(category))
    return summary.agg(
        F.min_by(category, best).alias("highest_category"),
        F.max("rate_percent").alias("highest_rate_percent"),
        F.min_by(category, worst).alias("lowest_category"),
        F.min("rate_percent").alias("lowest_rate_percent"),
    )


def sort_mixed(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Sort by (column, 'asc' or 'desc') pairs with NULL always last."""
    return df.orderBy(
        *[
            F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last()
            for c, way in keys
        ]
    )


def eligible_counts(
    summaries: Mapping[str, DataFrame], thresholds: Sequence[int] = (100, 500, 1000)
) -> DataFrame:
    """How many categories of each dimension reach each minimum sample."""
    out = None
    for dimension, summary in summaries.items():
        counts = summary.agg(
            *[F.count_if(F.col("total") >= t).alias(str(t)) for t in thresholds]
        )
        part = counts.select(
            F.lit(dimension).alias("dimension"),
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(t).alias("minimum_rows"),
                            F.col(f"`{t}`").alias("eligible_categories"),
                        )
                        for t in thresholds
                    ]
                )
            ).alias("row"),
        ).select("dimension", "row.*")
        out = part if out is None else out.unionByName(part)
    return out


def eligible_from_cells(
    cells: DataFrame,
    thresholds: Sequence[int] = (100, 500, 1000),
    excluded: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``eligible_counts`` of all dimensions of ``rates.dimension_cells``, so the table is scanned once.

    ``excluded`` names categories per dimension, as text, that are not counted. A NULL category fails the query.
    """
    counted = F.lit(True)
    for dimension, values in (excluded or {}).items():
        counted = counted & ~((F.col("dimension") == dimension) & F.col("category").isin(*values))
    totals = cells.where(all_present(["category"])).groupBy("dimension", "category").agg(
        F.sum(cell_total()).alias("total")
    )
    found = totals.groupBy("dimension").agg(
        *[F.count_if(counted & (F.col("total") >= t)).alias(f"n{i}") for i, t in enumerate(thresholds)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("minimum_rows"), F.col(f"n{i}").alias("eligible_categories"))
            for i, t in enumerate(thresholds)
        ]
    )
    return found.select("dimension", F.inline(rows))


def minimum_rank(df: DataFrame, criteria: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Competition ranks of a small result table (a row per run, a row per feature).

    ``criteria`` maps a rank column to (measure, 'asc' or 'desc').
    """
    for name, (measure, way) in criteria.items():
        key = F.desc(measure) if way == "desc" else F.asc(measure)
        df = df.withColumn(name, F.rank().over(Window.orderBy(key)))
    return df


def numbered(df: DataFrame, measure: str, name: str, rank: str = "rank") -> DataFrame:
    """1-based position by descending measure, then name; for small result tables."""
    order = Window.orderBy(F.desc(measure), F.col(name))
    return df.withColumn(rank, F.row_number().over(order))

"""Outcome rates by category and period.

Every operator starts from ``tally``: flagged and unflagged rows per cell. The total is always
written as the sum of the two, so that a second aggregation over the cells needs exactly the same
columns as the first; Spark then reuses the shuffled cells instead of scanning the table again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import MAX_LITERAL_MAP, all_present, is_flagged, order_rank, percent
from ratescope.operators.joins import lookup


def cell_total() -> Column:
    return F.col("flagged") + F.col("unflagged")


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def tally(df: DataFrame, keys: str | Sequence[str], flag: str = "flag") -> DataFrame:
    """Flagged and unflagged rows per key; one shuffle of pre-aggregated cells."""
    yes = is_flagged(flag)
    return df.groupBy(*as_list(keys)).agg(
        F.count_if(yes).alias("flagged"), F.count_if(~yes).alias("unflagged")
    )


def grand_total(cells: DataFrame) -> Column:
    """Rows behind all cells as a scalar subquery over the same shuffled cells."""
    return cells.agg(F.sum(cell_total())).scalar()


def _measures() -> list[Column]:
    return [
        cell_total().alias("total"),
        F.col("flagged"),
        F.col("unflagged"),
        percent("flagged", cell_total()).alias("rate_percent"),
    ]


def rate_summary(
    df: DataFrame,
    categories: str | Sequence[str],
    flag: str = "flag",
    order: Sequence | None = None,
) -> DataFrame:
    """Total, flagged, unflagged, rate and share of all rows per category.

    A NULL category fails the query. With ``order`` (one category column) the rows come back in
    that order and a value outside it fails the query.
    """
    names = as_list(categories)
    cells = tally(df.where(all_present(names)), names, flag)
    out = cells.select(
        *names, *_measures(), percent(cell_total(), grand_total(cells)).alias("share_percent")
    )
    return out if order is None else sort_by_order(out, names[0], order)


def rate_by_period(
    df: DataFrame,
    categories: str | Sequence[str],
    flag: str = "flag",
    period: str = "period",
    with_share: bool = False,
) -> DataFrame:
    """``rate_summary`` per period; ``with_share`` adds the share of that period's rows."""
    names = as_list(categories)
    cells = tally(df.where(all_present(names)), [period, *names], flag)
    keys = [period, *names]
    if not with_share:
        return cells.select(*keys, *_measures())
    totals = period_totals(cells, period)
    return cells.join(totals, period).select(
        *keys, *_measures(), percent(cell_total(), "period_total").alias("period_share_percent")
    )


def period_totals(cells: DataFrame, period: str = "period") -> DataFrame:
    return cells.groupBy(period).agg(F.sum(cell_total()).alias("period_total"))


def sort_by_order(
    df: DataFrame, category: str, order: Sequence, first: Sequence[str] = ()
) -> DataFrame:
    """Rows in a fixed category order of any length, optionally below leading sort columns."""
    if len(order) <= MAX_LITERAL_MAP:
        return df.orderBy(*first, order_rank(order, category, category))
    place = {value: number for number, value in enumerate(order)}
    return lookup(df, category, place, "_place", category).orderBy(*first, "_place").drop("_place")


# --- many dimensions at once -----------------------------------------------------------------


def dimension_cells(
    df: DataFrame, dimensions: Mapping[str, str], flag: str = "flag", period: str = "period"
) -> DataFrame:
    """(dimension, category, period, flagged, unflagged) of all dimensions from one scan.

    ``dimensions`` maps a name to its column; categories become text. Summaries, by-period tables,
    stability and contrasts are sums over these cells, so a caller that wants many of them settles
    the cells and never reads the table again.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"), F.col(column).cast("string").alias("category")
            )
            for name, column in dimensions.items()
        ]
    )
    long = df.select(period, is_flagged(flag).alias("_yes"), F.inline(pairs))
    return long.groupBy("dimension", "category", period).agg(
        F.count_if("_yes").alias("flagged"), F.count_if(~F.col("_yes")).alias("unflagged")
    )


def _own_cells(cells: DataFrame, dimension: str) -> DataFrame:
    """The cells of one dimension; a NULL category among them, and only there, fails the query."""
    own = F.col("dimension") == dimension
    return cells.where(own).where(F.when(own, all_present(["category"])))


def summary_from_cells(
    cells: DataFrame, dimension: str, order: Sequence | None = None
) -> DataFrame:
    """``rate_summary`` of one dimension of ``dimension_cells``."""
    own = _own_cells(cells, dimension)
    out = (
        own.groupBy("category")
        .agg(F.sum("flagged").alias("flagged"), F.sum("unflagged").alias("unflagged"))
        .select(
            "category",
            *_measures(),
            percent(cell_total(), grand_total(own)).alias("share_percent"),
        )
    )
    return out if order is None else sort_by_order(out, "category", order)


def by_period_from_cells(cells: DataFrame, dimension: str, period: str = "period") -> DataFrame:
    """``rate_by_period`` with period shares for one dimension of ``dimension_cells``."""
    own = _own_cells(cells, dimension)
    return own.join(period_totals(own, period), period).select(
        period,
        "category",
        *_measures(),
        percent(cell_total(), "period_total").alias("period_share_percent"),
    )


# --- periods ---------------------------------------------------------------------------------


def period_summary(df: DataFrame, flag: str = "flag", period: str = "period") -> DataFrame:
    """One row per period with rates, share of all rows and change against the period before.

    The ordered window sees one row per period, never the table's rows.
    """
    cells = tally(df, period, flag)
    before = F.lag("total").over(Window.orderBy(period))
    return (
        cells.select(
            F.col(period),
            *_measures(),
            percent("unflagged", cell_total()).alias("unflagged_rate_percent"),
            percent(cell_total(), grand_total(cells)).alias("share_percent"),
        )
        .withColumn("change_percent", F.round((F.col("total") / before - 1) * 100, 6))
        .orderBy(period)
    )


def rate_range(by_period: DataFrame) -> DataFrame:
    """Lowest, highest, spread, plain mean and weighted rate over the periods."""
    low, high = F.min("rate_percent"), F.max("rate_percent")
    return by_period.agg(
        low.alias("minimum_rate_percent"),
        high.alias("maximum_rate_percent"),
        F.round(high - low, 6).alias("range_points"),
        F.avg("rate_percent").alias("mean_rate_percent"),
        (F.sum("flagged") / F.sum("total") * 100).alias("weighted_rate_percent"),
    )


def rate_spread(by_period: DataFrame, categories: Sequence[str], period: str) -> DataFrame:
    """Volume, periods observed and lowest, highest and spread of the rate per category."""
    low, high = F.min("rate_percent"), F.max("rate_percent")
    return by_period.groupBy(*categories).agg(
        F.count_distinct(period).alias("periods_observed"),
        F.sum("total").alias("total"),
        low.alias("minimum_rate_percent"),
        high.alias("maximum_rate_percent"),
        F.round(high - low, 6).alias("range_points"),
    )


def rate_with_stability(
    df: DataFrame,
    categories: str | Sequence[str],
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """``rate_summary`` and the spread of the per-period rate, from one scan and one shuffle of
    (period, category) cells."""
    names = as_list(categories)
    cells = tally(df.where(all_present(names)), [period, *names], flag)
    rate = percent("flagged", cell_total())
    return (
        cells.groupBy(*names)
        .agg(
            F.sum("flagged").alias("flagged"),
            F.sum("unflagged").alias("unflagged"),
            F.count(F.lit(1)).alias("periods_observed"),
            F.min(rate).alias("minimum_rate_percent"),
            F.max(rate).alias("maximum_rate_percent"),
        )
        .select(
            *names,
            *_measures(),
            percent(cell_total(), grand_total(cells)).alias("share_percent"),
            "periods_observed",
            "minimum_rate_percent",
            "maximum_rate_percent",
            F.round(F.col("maximum_rate_percent") - F.col("minimum_rate_percent"), 6).alias(
                "range_points"
            ),
        )
    )


def stability(
    by_period: dict[str, tuple[DataFrame, str]], period: str = "period"
) -> DataFrame:
    """Spread of the rate over periods per category, for several dimensions stacked.

    ``by_period`` maps a dimension name to its by-period table and category column.
    """
    parts = [
        rate_spread(table, [category], period).select(
            F.lit(dimension).alias("dimension"),
            F.col(category).cast("string").alias("category"),
            "periods_observed",
            "minimum_rate_percent",
            "maximum_rate_percent",
            "range_points",
        )
        for dimension, (table, category) in by_period.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def stability_from_cells(cells: DataFrame, period: str = "period") -> DataFrame:
    """``stability`` of all dimensions of ``dimension_cells``, so the table is scanned once.

    A NULL category fails the query.
    """
    table = cells.where(all_present(["category"])).withColumns(
        {"total": cell_total(), "rate_percent": percent("flagged", cell_total())}
    )
    return rate_spread(table, ["dimension", "category"], period).drop("total")


def calendar_days(periods: DataFrame, period: str = "period") -> DataFrame:
    """Days of each month summed over the distinct years, leap years included."""
    return (
        periods.select(F.col(period).alias("year"))
        .distinct()
        .select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
        .groupBy("month")
        .agg(F.sum(F.day(F.last_day(F.make_date("year", "month", F.lit(1))))).alias("calendar_days"))
    )


def calendar_rate(
    df: DataFrame, month: str, flag: str = "flag", period: str = "period"
) -> DataFrame:
    """``rate_summary`` by month number with calendar days and rows per calendar day.

    Months, their total and the years observed all come from the same (year, month) cells.
    """
    cells = tally(df.where(all_present([month])), [period, month], flag)
    years = cells.where(cell_total() > 0).select(period)
    days = calendar_days(years, period).withColumnRenamed("month", month)
    return (
        cells.groupBy(month)
        .agg(F.sum("flagged").alias("flagged"), F.sum("unflagged").alias("unflagged"))
        .join(days, month, "left")
        .select(
            month,
            *_measures(),
            percent(cell_total(), grand_total(cells)).alias("share_percent"),
            "calendar_days",
            F.round(cell_total() / F.col("calendar_days"), 6).alias("rows_per_calendar_day"),
        )
    )


def value_distribution(df: DataFrame, value: str, flag: str = "flag") -> DataFrame:
    """Exact distribution of a count, in value order."""
    return rate_summary(df, value, flag).orderBy(value)


# --- reconciliation --------------------------------------------------------------------------


def reconcile_totals(df: DataFrame, summary: DataFrame, what: str = "summary") -> DataFrame:
    """Check table: group totals add up to the rows; both classes add up to the total."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    return summary.agg(
        F.sum("total").alias("group_rows"),
        F.count_if(F.col("flagged") + F.col("unflagged") != F.col("total")).alias("class_mismatches"),
    ).select(
        F.lit(what).alias("summary"),
        rows.alias("table_rows"),
        "group_rows",
        (rows == F.col("group_rows")).alias("rows_match"),
        "class_mismatches",
    )

"""How distributions differ between two sets of periods (development and comparison)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.functions import category_label, percent, ratio_or_zero
from ratescope.operators.joins import union_relaxed
from ratescope.operators.quality import calendar_coverage, time_coverage
from ratescope.operators.quantiles import ACCURACY, borders_passed, exact_quantiles, long_numbers
from ratescope.operators.statistics import DECILES, QUARTILES_AND_TAIL, ROWS_PER_RANGE
from ratescope.operators.tokens import token_cells
from ratescope.runtime import settle


def _sides(period: str, development: Sequence[int], comparison: Sequence[int]):
    return F.col(period).isin(*development), F.col(period).isin(*comparison)


def side_rows(counts: DataFrame, variables: int) -> Column:
    """Rows of both sides as one scalar, from value counts in which each row appears once per
    variable; Spark reuses the shuffled counts for it."""
    return counts.agg(
        F.struct(
            (F.sum("development") / variables).alias("development"),
            (F.sum("comparison") / variables).alias("comparison"),
        )
    ).scalar()


def both_sides(rows: Column) -> Column:
    """Fails where one side has no rows."""
    there = (F.coalesce(rows["development"], F.lit(0)) > 0) & (F.coalesce(rows["comparison"], F.lit(0)) > 0)
    return F.when(there, F.lit(True)).otherwise(F.raise_error(F.lit("one side of the comparison is empty")).cast("boolean"))


def long_values(df: DataFrame, variables: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep…, variable, value) with every variable as text."""
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"))
            for v in variables
        ]
    )
    return df.select(*keep, F.inline(pairs))


def total_variation_distance(cells: DataFrame, development: str, comparison: str) -> DataFrame:
    """Half the summed absolute difference of two normalised counts; empty sides count as 0."""
    sums = cells.agg(
        F.struct(F.sum(development).alias("d"), F.sum(comparison).alias("c"))
    ).scalar()
    gap = F.abs(ratio_or_zero(development, sums["d"]) - ratio_or_zero(comparison, sums["c"]))
    return cells.agg(F.coalesce(F.sum(gap) / 2, F.lit(0.0)).alias("tvd"))


def _value_counts(df, variables, period, dev, cmp, first_period=False) -> DataFrame:
    extra = [F.min(period).alias("first_period")] if first_period else []
    return (
        long_values(df, variables, [period])
        .groupBy("variable", category_label("value").alias("value"))
        .agg(F.count_if(dev).alias("development"), F.count_if(cmp).alias("comparison"), *extra)
        .where(F.col("development") + F.col("comparison") > 0)
    )


def categorical_drift(
    df: DataFrame,
    variables: Sequence[str],
    development: Sequence[int],
    comparison: Sequence[int],
    period: str = "period",
) -> DataFrame:
    """Distance, category turnover and the largest share change for many variables.

    All variables are grouped in one pass. Every row has one value per variable, so the number of
    rows of a side is the denominator of all of them and follows from the same cells.
    """
    dev, cmp = _sides(period, development, comparison)
    d, c = F.col("development"), F.col("comparison")
    counts = _value_counts(df, variables, period, dev, cmp)
    rows = side_rows(counts, len(variables))
    cells = counts.where(both_sides(rows)).select(
        "variable",
        "value",
        d,
        c,
        ratio_or_zero(d, rows["development"]).alias("d_share"),
        ratio_or_zero(c, rows["comparison"]).alias("c_share"),
    )
    change = F.abs((F.col("c_share") - F.col("d_share")) * 100)
    new, gone = (d == 0) & (c > 0), (d > 0) & (c == 0)
    pick = F.struct(-change, F.col("value"))
    largest = F.min_by(F.struct("value", "d_share", "c_share"), pick)
    return (
        cells.groupBy("variable")
        .agg(
            F.round(F.sum(F.abs(F.col("d_share") - F.col("c_share"))) / 2, 9).alias("tvd"),
            F.count_if(d > 0).alias("development_categories"),
            F.count_if(c > 0).alias("comparison_categories"),
            F.count_if((d > 0) & (c > 0)).alias("shared_categories"),
            F.count_if(new).alias("new_categories"),
            F.count_if(gone).alias("missing_categories"),
            F.coalesce(F.sum(F.when(new, c)), F.lit(0)).alias("new_rows"),
            largest.alias("largest"),
        )
        .select(
            "variable",
            "tvd",
            "development_categories",
            "comparison_categories",
            "shared_categories",
            "new_categories",
            "missing_categories",
            "new_rows",
            F.round(ratio_or_zero("new_rows", rows["comparison"]) * 100, 9).alias("new_share_percent"),
            F.col("largest.value").alias("largest_change_category"),
            F.round(
                F.abs((F.col("largest.c_share") - F.col("largest.d_share")) * 100), 9
            ).alias("largest_change_points"),
            F.round(F.col("largest.d_share") * 100, 9).alias("development_share_percent"),
            F.round(F.col("largest.c_share") * 100, 9).alias("comparison_share_percent"),
        )
    )


def new_categories(
    df: DataFrame,
    variables: Sequence[str],
    development: Sequence[int],
    comparison: Sequence[int],
    period: str = "period",
) -> DataFrame:
    """Categories seen in the comparison periods only."""
    dev, cmp = _sides(period, development, comparison)
    counts = _value_counts(df, variables, period, dev, cmp, first_period=True)
    seen = F.col("first_period").isNotNull()
    rows = side_rows(counts.where(F.when(seen, F.col("comparison") >= 0)), len(variables))
    return (
        counts.where((F.col("development") == 0) & (F.col("comparison") > 0))
        .select(
            "variable",
            F.col("value").alias("category"),
            F.col("comparison").alias("comparison_rows"),
            percent("comparison", rows["comparison"], 9).alias("comparison_share_percent"),
            "first_period",
        )
    )


# --- numeric ---------------------------------------------------------------------------------


def with_side(df: DataFrame, development: Sequence[int], comparison: Sequence[int], period: str) -> DataFrame:
    """The rows of both sides, marked as ``side``."""
    dev, cmp = _sides(period, development, comparison)
    return df.where(dev | cmp).withColumn("side", F.when(dev, "development").otherwise("comparison"))


def side_cells(
    df: DataFrame,
    columns: Sequence[str],
    development: Sequence[int],
    comparison: Sequence[int],
    period: str,
) -> DataFrame:
    """(side, variable, value, n) of the finite values of both sides."""
    numbers = long_numbers(with_side(df, development, comparison, period), columns, ["side"])
    return numbers.groupBy("side", "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def apply_bins(
    cells: DataFrame, edges: DataFrame, by: Sequence[str] = (), most_edges: int = len(DECILES)
) -> DataFrame:
    """Rows per bin; bin = number of edges at or below the value, so extremes fall in end bins.

    ``cells`` has (by…, variable, value, n), ``edges`` one array of up to ``most_edges`` numbers per
    variable.
    """
    return (
        cells.join(edges.select("variable", "edges"), "variable")
        .withColumn("bin", borders_passed("edges", most_edges))
        .groupBy(*by, "variable", "bin")
        .agg(F.sum("n").alias("rows"))
    )


def numeric_drift(
    df: DataFrame,
    continuous: Sequence[str],
    discrete: Sequence[str],
    development: Sequence[int],
    comparison: Sequence[int],
    period: str = "period",
    shares: Sequence[float] = DECILES,
    rows_per_range: int = ROWS_PER_RANGE,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Statistics of both sides and a distance: over development deciles for continuous columns,
    over exact values for discrete ones.

    Quantiles come from brackets, and one more scan counts the rows per bin and per discrete value, so no
    continuous value is shuffled but those inside a bracket, at most ``rows_per_range`` each. It is an error
    when no variable has a value on one of the sides.
    """
    sided = with_side(df, development, comparison, period)
    quantiles = {f"_q{i}": p for i, p in enumerate(shares)}
    # One row per side and variable; it feeds the edges, the bins and the result.
    stats = settle(
        exact_quantiles(
            sided,
            [*continuous, *discrete],
            ["side"],
            QUARTILES_AND_TAIL | quantiles,
            accuracy=accuracy,
            most_inside=rows_per_range,
        )
    )
    found = {r["side"] for r in stats.select("side").distinct().collect()}
    if missing := {"development", "comparison"} - found:
        raise ValueError(f"one side of the comparison is empty: {', '.join(sorted(missing))}")
    names = ["n", "minimum", *QUARTILES_AND_TAIL, "mean", "maximum"]
    wide = stats.groupBy("variable").agg(
        *[
            F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{s}_{n}")
            for s in ("development", "comparison")
            for n in names
        ]
    )
    of_development = (F.col("side") == "development") & F.col("variable").isin(*continuous)
    edges = stats.where(of_development).select(
        "variable", F.array_distinct(F.array(*quantiles)).alias("edges")
    )
    parts = []
    if continuous:
        numbers = long_numbers(sided, continuous, ["side"]).withColumn("n", F.lit(1))
        binned = apply_bins(numbers, edges, ["side"], len(shares))
        parts.append(binned.select("side", "variable", F.col("bin").cast("double").alias("value"), F.col("rows").alias("n")))
    if discrete:
        parts.append(side_cells(df, discrete, development, comparison, period))
    distance = _side_distance(reduce(DataFrame.unionByName, parts))
    return (
        distance.join(edges, "variable", "left")
        .join(wide, "variable")
        .select(
            "variable",
            F.when(F.col("edges").isNull(), "discrete_exact_tvd")
            .otherwise("development_decile_binned_tvd")
            .alias("audit_method"),
            "distribution_tvd",
            (F.size("edges") + 1).alias("development_bin_count"),
            F.concat_ws("|", F.col("edges").cast("array<string>")).alias("development_edges"),
            *[c for c in wide.columns if c != "variable"],
        )
    )


def _side_distance(groups: DataFrame) -> DataFrame:
    """Total variation distance per variable from (side, variable, value, n)."""
    d = F.sum(F.when(F.col("side") == "development", F.col("n")).otherwise(0))
    c = F.sum(F.when(F.col("side") == "comparison", F.col("n")).otherwise(0))
    cells = groups.groupBy("variable", "value").agg(d.alias("d"), c.alias("c"))
    sums = cells.groupBy("variable").agg(F.sum("d").alias("dn"), F.sum("c").alias("cn"))
    gap = F.abs(ratio_or_zero("d", "dn") - ratio_or_zero("c", "cn"))
    return (
        cells.join(sums, "variable")
        .groupBy("variable")
        .agg(F.round(F.sum(gap) / 2, 9).alias("distribution_tvd"))
    )


# --- multi-valued fields and yearly profiles -------------------------------------------------


def multilabel_drift(
    df: DataFrame,
    field: str,
    development: Sequence[int],
    comparison: Sequence[int],
    period: str = "period",
    known: Sequence[str] | None = None,
    delimiter: str = ";",
) -> DataFrame:
    """Prevalence difference per token. Tokens are not exclusive, so there is no distance."""
    dev, cmp = _sides(period, development, comparison)
    cells = token_cells(df.withColumn("_flag", F.lit(True)), field, [period], "_flag", known, delimiter)
    # Few cells (tokens × periods) are read twice, so they are settled after the one pass.
    cells = settle(cells)
    rows = cells.agg(
        F.struct(
            F.sum(F.when(dev, F.col("starts"))).alias("development"),
            F.sum(F.when(cmp, F.col("starts"))).alias("comparison"),
        )
    ).scalar()
    d = F.coalesce(F.sum(F.when(dev, F.col("flagged"))), F.lit(0))
    c = F.coalesce(F.sum(F.when(cmp, F.col("flagged"))), F.lit(0))
    periods = F.array_sort(F.collect_set(period)).cast("array<string>")
    shares = cells.where(F.col("token").isNotNull()).groupBy("token").agg(
        d.alias("development_rows"), c.alias("comparison_rows"), periods.alias("periods")
    ).withColumns(
        {
            "_d": ratio_or_zero("development_rows", rows["development"]) * 100,
            "_c": ratio_or_zero("comparison_rows", rows["comparison"]) * 100,
        }
    )
    return shares.where(F.col("development_rows") + F.col("comparison_rows") > 0).select(
        "token",
        "development_rows",
        F.round("_d", 9).alias("development_prevalence_percent"),
        "comparison_rows",
        F.round("_c", 9).alias("comparison_prevalence_percent"),
        F.round(F.col("_c") - F.col("_d"), 9).alias("difference_points"),
        F.round(F.abs(F.col("_c") - F.col("_d")), 9).alias("absolute_difference_points"),
        F.concat_ws("|", "periods").alias("periods_present"),
        F.when(F.col("development_rows") == 0, "new")
        .when(F.col("comparison_rows") == 0, "missing")
        .otherwise("shared")
        .alias("presence"),
    )


def annual_mode(df: DataFrame, variables: Sequence[str], period: str = "period") -> DataFrame:
    """Per variable and period: filled rows, distinct values and the most frequent value.

    Equal counts go to the smaller label. Grouping replaces a ranking window.
    """
    cells = (
        long_values(df, variables, [period])
        .groupBy("variable", period, "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", category_label("value"))
    )
    return cells.groupBy("variable", period).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias(
            "non_null_rows"
        ),
        F.count(F.lit(1)).alias("distinct_values"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top_category"),
        F.max("n").alias("top_category_rows"),
        percent(F.max("n"), F.sum("n"), 9).alias("top_category_share_percent"),
    )


def annual_profile(
    df: DataFrame,
    variables: Sequence[str],
    date: str,
    month_label: str,
    label_of: Column,
    time: str,
    hour: str,
    period: str = "period",
) -> DataFrame:
    """Modes, calendar coverage and time coverage stacked; missing measures are NULL."""
    return union_relaxed(
        [
            annual_mode(df, variables, period),
            calendar_coverage(df, date, month_label, label_of, period),
            time_coverage(df, time, hour, period),
        ]
    )

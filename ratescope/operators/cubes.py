"""Additive cubes, facet filters over them, and comparisons between two sets of totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescope.functions import all_present, selection
from ratescope.operators.rates import cell_total, as_list, tally


def cube(df: DataFrame, dimensions: Sequence[str], flag: str = "flag") -> DataFrame:
    """Observed cells only: total, flagged, unflagged and proportion 0–1.

    NULL in a dimension or in the flag fails the query.
    """
    checked = df.where(all_present([*dimensions, flag]))
    return tally(checked, dimensions, flag).select(
        *dimensions,
        cell_total().alias("total"),
        "flagged",
        "unflagged",
        (F.col("flagged") / cell_total()).alias("proportion"),
    )


def cubes(
    df: DataFrame, dimension_sets: Mapping[str, Sequence[str]], flag: str = "flag"
) -> DataFrame:
    """Several cubes from one scan. ``cube`` names the set a cell belongs to; dimensions outside
    that set are NULL."""
    every = list(dict.fromkeys(d for dims in dimension_sets.values() for d in dims))
    checked = df.where(all_present([*every, flag])).select(*every, flag)
    sets = [[F.col(d) for d in dims] for dims in dimension_sets.values()]
    name = F.lit(None).cast("string")
    for label, dims in dimension_sets.items():
        inside = [F.grouping(d) == (0 if d in dims else 1) for d in every]
        test = inside[0]
        for other in inside[1:]:
            test = test & other
        name = F.when(test, label).otherwise(name)
    return (
        checked.groupingSets(sets, *every)
        .agg(
            name.alias("cube"),
            F.count_if(F.col(flag)).alias("flagged"),
            F.count_if(~F.col(flag)).alias("unflagged"),
        )
        .select(
            "cube",
            *every,
            cell_total().alias("total"),
            "flagged",
            "unflagged",
            (F.col("flagged") / cell_total()).alias("proportion"),
        )
    )


def roll_up_cube(
    cells: DataFrame, label: str | Sequence[str], filters: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Filter a cube by facets and add its counts up; the proportion comes from the sums."""
    names = as_list(label)
    return (
        cells.where(selection(filters or {}))
        .groupBy(*names)
        .agg(
            F.sum("total").alias("total"),
            F.sum("flagged").alias("flagged"),
            F.sum("unflagged").alias("unflagged"),
        )
        .withColumn("proportion", F.col("flagged") / F.col("total"))
    )


def facet_values(cells: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Distinct values per dimension in long form, one row each."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                for d in dimensions
            ]
        )
    )
    return cells.select(pairs.alias("p")).select("p.*").distinct()


def dependent_facets(cells: DataFrame, parent: str, child: str) -> DataFrame:
    """The child values that occur under each parent value, one row each."""
    return cells.select(parent, child).distinct()


def sort_cube(
    cells: DataFrame, dimensions: Sequence[str], orders: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Cells in dimension order: a fixed order where given (unknown values after it), numbers
    before text, text without regard to case."""
    keys = []
    for d in dimensions:
        text = F.col(d).cast("string")
        if d in (orders or {}):
            known = F.array(*[F.lit(str(v)) for v in orders[d]])
            place = F.array_position(known, text)
            keys += [F.when(place == 0, 999_999).otherwise(place), text]
        else:
            number = text.try_cast("double")
            keys += [F.when(number.isNull(), 1).otherwise(0), number, F.lower(text), text]
    return cells.orderBy(*keys)


def reconcile_tables(
    expected: DataFrame, exported: DataFrame, scope: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Metric by metric: expected value, exported value and PASS or FAIL per scope."""
    keys = list(scope)

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias(name))
                for m in metrics
            ]
        )
        return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")

    return (
        long(expected, "expected_value")
        .join(long(exported, "exported_value"), [*keys, "metric"], "full_outer")
        .withColumn(
            "status",
            F.when(
                F.col("expected_value").eqNullSafe(F.col("exported_value")), "PASS"
            ).otherwise("FAIL"),
        )
    )

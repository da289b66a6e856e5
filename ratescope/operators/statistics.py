"""Exact running totals and quantiles over a global order, without a single-task window.

A window without partitions moves every distinct value into one task. Here the distinct values are
cut into ranges first, each a window of its own, and the small table of range totals supplies what
lies before it. Quantiles of cells go further: only the ranges that hold a wanted position are sorted.
Quantiles of columns need no cells at all, see ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import is_finite
from ratescope.operators.quantiles import ACCURACY, exact_quantiles
from ratescope.runtime import settle

#: Distinct values one window may hold before the values are cut into ranges.
ROWS_PER_RANGE = 200_000
FIRST_RANGES = 1_000
#: Ranges made at one level; ranges that are still too large are cut again.
MAXIMUM_RANGES = 10_000
DEEPEST = 8
#: Largest number of range rows that is sent to every task.
BROADCAST_ROWS = 200_000

# The quantiles reported for a numeric column, and the decile shares.
QUARTILES_AND_TAIL = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
DECILES = tuple(i / 10 for i in range(1, 10))


# --- ranges ----------------------------------------------------------------------------------


def range_cuts(
    cells: DataFrame, value: str, rows_per_range: int, maximum_ranges: int = MAXIMUM_RANGES
) -> list[float]:
    """Inner borders of value ranges with about ``rows_per_range`` cells each.

    Only these few numbers reach the driver (at most ``maximum_ranges``), from a mergeable sketch.
    The borders need not be exact: they decide how work is split, not what comes out.
    """

    def sketch(ranges: int):
        shares = [i / ranges for i in range(1, ranges)]
        accuracy = max(10_000, 10 * ranges)
        cuts = F.percentile_approx(F.col(value).cast("double"), shares, accuracy)
        return cells.agg(F.count(F.lit(1)).alias("cells"), cuts.alias("cuts")).first()

    found = sketch(FIRST_RANGES)
    ranges = min(-(-found["cells"] // rows_per_range), maximum_ranges)
    if ranges <= 1:
        return []
    cuts = found["cuts"] if ranges <= FIRST_RANGES else sketch(ranges)["cuts"]
    step = max(1, (len(cuts) + 1) // ranges)
    return sorted(set(cuts[step - 1 :: step]))


def located(cells: DataFrame, value: str, cuts: Sequence[float], name: str = "_range") -> DataFrame:
    """Cells with the number of their range."""
    splits = [float("-inf"), *cuts, float("inf")]
    with_input = cells.withColumn("_x", F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="_x", outputCol=name).transform(with_input).drop("_x")


def _add_starts(
    done: DataFrame, placed: DataFrame, by: Sequence[str], part: str, sums: Sequence[str], descending: bool
) -> DataFrame:
    """Adds what lies before each range of ``by`` to the totals inside the ranges."""
    way = F.desc(part) if descending else F.asc(part)
    before = Window.partitionBy(*by).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, part)
        .agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        .select(*by, part, *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums])
    )
    return (
        done.join(starts, [*by, part])
        .withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_{s}") for s in sums})
        .drop(part, *[f"_{s}" for s in sums])
    )


def _totals_inside(
    placed: DataFrame,
    value: str,
    sums: Sequence[str],
    key: Sequence[str],
    descending: bool,
    rows_per_range: int,
    maximum_ranges: int,
    uneven: bool,
    level: int = 1,
) -> DataFrame:
    """Running totals within each range ``key``, a window of its own.

    Where ranges may be too large (``uneven``), those of more than twice ``rows_per_range`` cells are cut again, all by
    the same borders: a cell's place between its range's lowest and highest value.
    """
    way = F.desc(value) if descending else F.asc(value)
    upto = Window.partitionBy(*key).orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    totals = {f"cum_{s}": F.sum(s).over(upto) for s in sums}
    if not uneven or level > DEEPEST:
        return placed.withColumns(totals)
    at = F.col(value).cast("double") / 2  # halves, so that no difference overflows
    large = settle(
        placed.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_cells"), F.min(at).alias("_low"), F.max(at).alias("_high"))
        .where(F.col("_cells") > 2 * rows_per_range)
    )
    number = large.count()
    if not number:
        return placed.withColumns(totals)
    share = F.try_divide(at - F.col("_low"), F.col("_high") - F.col("_low"))
    again = placed.join(large, list(key)).withColumn("_share", F.coalesce(share, F.lit(0.0)))
    cuts = range_cuts(again, "_share", rows_per_range * number, maximum_ranges)
    if not cuts:
        return placed.withColumns(totals)
    part = f"_range{level}"
    again = located(again, "_share", cuts, part).drop("_cells", "_low", "_high", "_share")
    inside = _totals_inside(
        again, value, sums, [*key, part], descending, rows_per_range, maximum_ranges, True, level + 1
    )
    small = placed.join(large.select(*key), list(key), "left_anti").withColumns(totals)
    return small.unionByName(_add_starts(inside, again, key, part, sums, descending))


def _may_be_uneven(cuts: Sequence[float], maximum_ranges: int) -> bool:
    """Whether so many ranges were asked for that their number may have been held down."""
    return len(cuts) + 1 >= maximum_ranges // 2


def running_totals(
    cells: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
    maximum_ranges: int = MAXIMUM_RANGES,
) -> DataFrame:
    """Adds ``cum_<s>``: the sum of ``s`` over all cells up to this one in value order within ``by``.

    ``cells`` has one row per (by, value); values are finite, ``by`` is never NULL. The cells
    should be settled, because they are read more than once. With any number of cells no window holds more than
    about twice ``rows_per_range`` of them.
    """
    by = list(by)
    cuts = range_cuts(cells, value, rows_per_range, maximum_ranges)
    if not cuts:
        return _totals_inside(cells, value, sums, by, descending, rows_per_range, maximum_ranges, False)
    # The window already spreads the cells by (by, range), so the join moves only the starts.
    placed = located(cells, value, cuts)
    uneven = _may_be_uneven(cuts, maximum_ranges)
    inside = _totals_inside(
        placed, value, sums, [*by, "_range"], descending, rows_per_range, maximum_ranges, uneven
    )
    return _add_starts(inside, placed, by, "_range", sums, descending)


# --- quantiles -------------------------------------------------------------------------------


def frequency_cells(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, variable, value, n) for all numeric columns at once; non-finite values are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(*by, F.inline(pairs))
        .where(is_finite("value"))
        .groupBy(*by, "variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _linear_position(share: float) -> Column:
    return (F.col("rows") - 1) * F.lit(float(share))


def _nearest_position(share: float) -> Column:
    """Half positions go up."""
    return F.floor(_linear_position(share) + F.lit(0.5))


def _positions(shares: Mapping[str, float], nearest: Sequence[str]) -> dict[str, tuple]:
    """Name → the 0-based positions below and above the quantile, and the part between them."""
    out = {}
    for name, share in shares.items():
        at = _nearest_position(share) if name in nearest else _linear_position(share)
        out[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    return out


def _holds(position: Column) -> Column:
    return (F.col("cum_n") - F.col("n") <= position) & (position < F.col("cum_n"))


def quantile_table(
    cells: DataFrame,
    by: Sequence[str],
    shares: Mapping[str, float],
    nearest: Sequence[str] = (),
    above: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    measures: bool = True,
    maximum_ranges: int = MAXIMUM_RANGES,
) -> DataFrame:
    """Exact quantiles of (by…, value, n) cells per group, with n, minimum, mean and maximum.

    Quantiles interpolate linearly unless listed in ``nearest``. ``above`` names a nearest quantile
    whose number of larger rows is added as ``rows_above_<name>``. Without ``measures`` only the
    quantiles are returned, and ``by`` may be empty. The cells should be settled.
    """
    key = list(by)
    positions = _positions(shares, nearest)
    cuts = range_cuts(cells, "value", rows_per_range, maximum_ranges)
    weight = F.sum(F.col("value") * F.col("n"))
    if cuts:
        ranges = settle(
            located(cells, "value", cuts)
            .groupBy(*key, "_range")
            .agg(
                F.sum("n").alias("_n"),
                F.min("value").alias("_min"),
                F.max("value").alias("_max"),
                weight.alias("_weight"),
            )
        )
        overall = ranges.groupBy(*key).agg(
            F.sum("_n").alias("rows"),
            F.min("_min").alias("minimum"),
            F.max("_max").alias("maximum"),
            F.sum("_weight").alias("weight"),
        )
        before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("_n").over(before), F.lit(0))
        placed = ranges.select(
            *key, "_range", "_n", start.alias("_start"),
            F.sum("_n").over(Window.partitionBy(*key)).alias("rows"),
        )
        wanted_here = F.lit(False)
        for low, high, _ in positions.values():
            for at in (low, high):
                wanted_here = wanted_here | (
                    (F.col("_start") <= at) & (at < F.col("_start") + F.col("_n"))
                )
        wanted = placed.where(wanted_here).drop("_n")
        if ranges.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        chosen = located(cells, "value", cuts).join(wanted, [*key, "_range"])
        uneven = _may_be_uneven(cuts, maximum_ranges)
        ranked = _totals_inside(
            chosen, "value", ["n"], [*key, "_range"], False, rows_per_range, maximum_ranges, uneven
        ).withColumn("cum_n", F.col("cum_n") + F.col("_start"))
    else:
        overall = cells.groupBy(*key).agg(
            F.sum("n").alias("rows"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
            weight.alias("weight"),
        )
        group = Window.partitionBy(*key)
        upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = cells.withColumns(
            {"cum_n": F.sum("n").over(upto), "rows": F.sum("n").over(group)}
        )

    picks = []
    for name, (low, high, part) in positions.items():
        a = F.max(F.when(_holds(low), F.col("value")))
        b = F.max(F.when(_holds(high), F.col("value")))
        picks.append((a + (b - a) * F.max(part)).alias(name))
        if name == above:
            larger = F.max(F.when(_holds(low), F.col("rows") - F.col("cum_n")))
            picks.append(larger.alias(f"rows_above_{name}"))
    picked = ranked.groupBy(*key).agg(*picks)
    if not measures:
        return picked
    measured = overall.select(
        *key,
        F.col("rows").alias("n"),
        "minimum",
        (F.col("weight") / F.col("rows")).alias("mean"),
        "maximum",
    )
    return measured.join(picked, key)


def numeric_summary_linear(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    exact: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Size, minimum, quantiles by linear interpolation, mean and maximum per numeric column.

    ``rows_per_range`` is the number of rows that one bracket may hold; ``exact=False`` takes the quantiles from
    one sketch.
    """
    return exact_quantiles(
        df, columns, by, QUARTILES_AND_TAIL, exact=exact, accuracy=accuracy, most_inside=rows_per_range
    )


def numeric_summary_nearest(
    df: DataFrame,
    columns: Sequence[str],
    rows_per_range: int = ROWS_PER_RANGE,
    exact: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """As above with quantiles taken from the data (the median stays interpolated), and the rows
    above the 99th percentile."""
    picked = [name for name in QUARTILES_AND_TAIL if name != "median"]
    return exact_quantiles(
        df, columns, (), QUARTILES_AND_TAIL, picked, "p99", exact, accuracy, rows_per_range
    ).drop("n")


def quantile_edges(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float] = DECILES,
    rows_per_range: int = ROWS_PER_RANGE,
    exact: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Distinct inner bin borders per column as a sorted array; the outer bins are open."""
    names = {f"_q{i}": p for i, p in enumerate(shares)}
    table = exact_quantiles(
        df, columns, (), names, exact=exact, accuracy=accuracy, most_inside=rows_per_range
    )
    return table.select("variable", F.array_distinct(F.array(*names)).alias("edges"))

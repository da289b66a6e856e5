"""Exact quantiles by brackets: a sketch says where to look, a second scan keeps only what lies there.

The first scan makes one mergeable sketch per group and column. It gives two borders around every wanted
position that are sure to hold it. The second scan counts the values between the brackets as a handful of
cells per task and keeps only those inside, a few hundredths of a percent, by value. No value outside a bracket is
shuffled or written. Brackets that would keep too many values are narrowed first, by sketches of what lies inside them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import is_finite
from ratescope.runtime import settle

#: A sketch's positions are right within rows / ACCURACY.
ACCURACY = 10_000
#: Rows that one bracket may be expected to hold before it is narrowed.
MOST_INSIDE = 200_000
#: Borders that a bracket is cut at when it is narrowed.
GRID = 256

INFINITY = float("inf")


class Positions:
    """The wanted quantiles of a group of ``rows`` values: name → 0-based places below and above, and the part between.

    Those in ``nearest`` are the value at the nearest place, half places going up; the others interpolate. The places are
    SQL over a column, which builds a plan with many of them in one step.
    """

    def __init__(self, shares: Mapping[str, float], nearest: Sequence[str]):
        self.shares = dict(sorted(shares.items(), key=lambda x: x[1]))
        self.nearest = set(nearest)

    def places(self, name: str, rows: str) -> tuple[str, str, str]:
        at = f"(({rows} - 1) * {float(self.shares[name])!r}D)"
        if name in self.nearest:
            at = f"CAST(floor({at} + 0.5D) AS DOUBLE)"
        return f"floor({at})", f"ceil({at})", f"({at} - floor({at}))"


def long_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str], *more: Column) -> DataFrame:
    """(by…, variable, value, more…) with one row per finite value; the rows are not moved."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*by, *more, F.inline(F.array(*pairs))).where(is_finite("value"))


def _first_brackets(df: DataFrame, columns: Sequence[str], by: Sequence[str], positions: Positions, accuracy: int) -> DataFrame:
    """(by…, variable, rows, lows, highs, inside): brackets of one scan, and the rows the widest may hold.

    A border is asked for two sketch errors beside the position, so it lies at least one error beside it.
    Groups of at most twice ``accuracy`` rows are all inside.
    """
    margin = 2.0 / accuracy
    asked = [min(1.0, max(0.0, p + m)) for m in (-margin, margin) for p in positions.shares.values()]
    n, rows = len(positions.shares), F.col("rows")
    sketched = (
        long_numbers(df, columns, by)
        .groupBy(*by, "variable")
        .agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("value", asked, accuracy).alias("borders"))
    )
    small = rows <= 2 * accuracy
    everywhere = lambda border: F.array_repeat(F.lit(border), n)
    return sketched.select(
        *by,
        "variable",
        "rows",
        F.when(small, everywhere(-INFINITY)).otherwise(F.slice("borders", 1, n)).alias("lows"),
        F.when(small, everywhere(INFINITY)).otherwise(F.slice("borders", n + 1, n)).alias("highs"),
        F.when(small, F.lit(0)).otherwise(F.ceil(rows * (2 * margin))).cast("long").alias("inside"),
    )


def _bracketed(df: DataFrame, columns: Sequence[str], by: Sequence[str], brackets: DataFrame) -> DataFrame:
    """(by…, variable, value, lows, highs): every finite value with its group's brackets.

    Without groups the brackets are a few numbers per column and written into the scan. Else they are one row per
    group, joined before the columns become rows.
    """
    if by:
        per_group = brackets.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(
            F.map_from_entries(F.collect_list(F.struct("variable", F.struct("lows", "highs")))).alias("_brackets")
        )
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        numbers = long_numbers(df.join(per_group, same), columns, by, F.col("_brackets"))
        numbers = numbers.withColumn("_b", F.element_at("_brackets", F.col("variable")))
        return numbers.select(*by, "variable", "value", F.col("_b.lows").alias("lows"), F.col("_b.highs").alias("highs"))
    found = {r["variable"]: r for r in brackets.select("variable", "lows", "highs").collect()}

    def of(side: str) -> Column:
        arrays = [F.when(F.col("variable") == v, F.array(*map(F.lit, r[side]))) for v, r in found.items()]
        return F.coalesce(*arrays) if arrays else F.lit(None).cast("array<double>")

    return long_numbers(df, columns, by).select("variable", "value", of("lows").alias("lows"), of("highs").alias("highs"))


def borders_passed(borders: str, most: int, strictly: bool = False) -> Column:
    """How many of the sorted ``borders`` (``most`` or fewer) lie at or below the value (below it, if ``strictly``).

    A binary search written out as nested conditions: few comparisons per row, and little enough generated code to be compiled.
    """

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        passed = f"get({borders}, {middle}) {'<' if strictly else '<='} value"
        return f"CASE WHEN {passed} THEN {search(middle + 1, high)} ELSE {search(low, middle)} END"

    return F.expr(search(0, most))


def _narrowed(df, columns, by, brackets: DataFrame, positions: Positions, accuracy: int, grid: int) -> DataFrame:
    """Brackets again, each cut down to a few parts of ``grid`` around its position.

    Every value lies in one stretch between two borders; rows are counted per stretch, and those inside a bracket are
    sketched. The exact number of rows before a stretch says which one holds a position, and where in it; so a position that the
    earlier brackets had missed is found again.
    """
    n, key = len(positions.shares), [*by, "variable"]
    shares = [i / grid for i in range(grid + 1)]
    entered, left = borders_passed("lows", n).alias("entered"), borders_passed("highs", n, strictly=True).alias("left")
    stretches = settle(
        _bracketed(df, columns, by, brackets)
        .select(*key, "value", entered, left)
        .groupBy(*key, "entered", "left")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("least"),
            F.max("value").alias("most"),
            F.percentile_approx(F.when(F.col("entered") > F.col("left"), F.col("value")), shares, accuracy).alias("cuts"),
        )
    )
    group = Window.partitionBy(*key)
    order = group.orderBy("entered", "left").rowsBetween(Window.unboundedPreceding, -1)
    placed = stretches.withColumns({"start": F.coalesce(F.sum("n").over(order), F.lit(0)), "rows": F.sum("n").over(group)})
    error = 2 + -(-grid // accuracy)

    def border(place: Column, up: bool) -> Column:
        """The grid border some parts beside ``place``, in the stretch that holds it."""
        part = F.floor((place - F.col("start")) * grid / F.col("n")).cast("int")
        cut = F.get("cuts", F.least(part + error, F.lit(grid)) if up else F.greatest(part - error + 1, F.lit(0)))
        edge = F.col("most") if up else F.col("least")
        at_end = (part + error >= grid) if up else (part - error + 1 <= 0)
        here = (F.col("start") <= place) & (place < F.col("start") + F.col("n"))
        return F.max(F.when(here, F.when(at_end | F.col("cuts").isNull(), edge).otherwise(cut)))

    lows, highs, held = [], [], []
    for name in positions.shares:
        low, high = map(F.expr, positions.places(name, "rows")[:2])
        a, b = border(low, False), border(high, True)
        here = (F.col("start") <= low) & (low < F.col("start") + F.col("n"))
        lows.append(a)
        highs.append(b)
        held.append(F.when(a == b, F.lit(0)).otherwise(F.max(F.when(here, F.col("n") * (2 * error + 1) / grid))))
    return placed.groupBy(*key).agg(
        F.first("rows").alias("rows"),
        F.array(*lows).alias("lows"),
        F.array(*highs).alias("highs"),
        F.ceil(F.greatest(F.lit(0), *held)).cast("long").alias("inside"),
    )


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str], brackets: DataFrame, n: int) -> DataFrame:
    """(by…, variable, least, most, n, weight): single values inside a bracket, one cell per stretch outside."""
    inside, entered = F.col("entered") > F.col("left"), F.col("entered")
    return (
        _bracketed(df, columns, by, brackets)
        .withColumns({"entered": borders_passed("lows", n), "left": borders_passed("highs", n, strictly=True)})
        .select(*by, "variable", "value", F.when(inside, F.col("value")).alias("kept"), F.when(~inside, entered).alias("stretch"))
        .groupBy(*by, "variable", "kept", "stretch")
        .agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("weight"))
        .drop("kept", "stretch")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    shares: Mapping[str, float] | None = None,
    nearest: Sequence[str] = (),
    above: str | None = None,
    exact: bool = True,
    accuracy: int = ACCURACY,
    most_inside: int = MOST_INSIDE,
    grid: int = GRID,
) -> DataFrame:
    """One row per group and numeric column: n, minimum, the quantiles in ``shares``, mean and maximum.

    Quantiles interpolate linearly unless listed in ``nearest``; ``above`` names a nearest quantile whose number of larger
    rows is added as ``rows_above_<name>``. NULL, NaN and infinite values are left out; a group or column without
    finite values has no row; a NULL in ``by`` is a group. ``df`` is scanned twice, and once more per narrowing,
    which ``accuracy / 4`` times ``most_inside`` rows in a group are needed for.

    With ``exact=False`` one scan answers, each quantile within rows / ``accuracy`` of its position, and ``above`` is
    counted for the position instead of the value.
    """
    by, positions, key = list(by), Positions(shares or {}, nearest), [*by, "variable"]
    if not exact:
        return _sketched(df, columns, by, positions, above, accuracy)
    brackets = settle(_first_brackets(df, columns, by, positions, accuracy))
    wide = brackets.agg(F.max("inside")).first()[0] or 0
    while wide > most_inside:
        brackets = settle(_narrowed(df, columns, by, brackets, positions, accuracy, grid))
        now = brackets.agg(F.max("inside")).first()[0] or 0
        if now >= wide:
            break
        wide = now
    while True:
        cells = settle(_cells(df, columns, by, brackets, len(positions.shares)))
        picked = settle(_picked(cells, key, positions, above))
        missed = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in positions.shares], F.lit(False))
        if not picked.where(missed).limit(1).count():
            return picked
        # a sketch that broke its promise: find the positions by exact counts
        brackets = settle(_narrowed(df, columns, by, brackets, positions, accuracy, grid))


def _picked(cells: DataFrame, key: list[str], positions: Positions, above: str | None) -> DataFrame:
    """The quantiles from ordered cells; NULL where a wanted place lies in a cell of more than one value."""
    group = Window.partitionBy(*key)
    upto = F.sum("n").over(group.orderBy("least").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumns({"upto": upto, "rows": F.sum("n").over(group)})
    names = list(positions.shares)
    places = {name: positions.places(name, "rows") for name in names}
    wanted = F.expr(f"array({', '.join(place for name in names for place in places[name][:2])})" if names else "array()")
    # the number of each wanted place that the cell holds, and the cell's value
    held = F.expr("filter(sequence(0, size(wanted) - 1), i -> upto - n <= get(wanted, i) AND get(wanted, i) < upto)") if names else F.array().cast("array<int>")
    value = F.when(F.col("least") == F.col("most"), F.struct(F.col("least").alias("value"), (F.col("rows") - F.col("upto")).alias("larger")))
    found = F.map_from_entries(F.flatten(F.collect_list(F.transform("held", lambda i: F.struct(i, F.col("cell"))))))
    summed = (
        ranked.withColumn("wanted", wanted)
        .withColumns({"held": held, "cell": value})
        .groupBy(*key)
        .agg(
            F.max("rows").alias("rows"),
            F.min("least").alias("minimum"),
            (F.sum("weight") / F.sum("n")).alias("mean"),
            F.max("most").alias("maximum"),
            found.alias("found"),
        )
    )
    picks = []
    for i, name in enumerate(names):
        low, high = f"try_element_at(found, {2 * i}).value", f"try_element_at(found, {2 * i + 1}).value"
        picks.append(f"{low} + ({high} - {low}) * {places[name][2]} AS `{name}`")
        if name == above:
            picks.append(f"try_element_at(found, {2 * i}).larger AS `rows_above_{name}`")
    return summed.select(*key, F.col("rows").alias("n"), "minimum", "mean", "maximum", *map(F.expr, picks))


def _sketched(df, columns, by, positions: Positions, above: str | None, accuracy: int) -> DataFrame:
    names = list(positions.shares)
    numbers = long_numbers(df, columns, by).groupBy(*by, "variable")
    found = numbers.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("minimum"),
        F.avg("value").alias("mean"),
        F.max("value").alias("maximum"),
        F.percentile_approx("value", [positions.shares[name] for name in names] or [0.5], accuracy).alias("_q"),
    )
    more = []
    if above:
        more = [F.expr(f"n - 1 - {positions.places(above, 'n')[0]}").alias(f"rows_above_{above}")]
    return found.select(*by, "variable", "n", "minimum", "mean", "maximum", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)], *more)

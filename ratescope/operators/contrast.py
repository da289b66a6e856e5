"""Contrasts: one category against another, for many dimensions in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.functions import percent, point_gap
from ratescope.operators.ranking import MINIMUM_ROWS
from ratescope.operators.rates import cell_total, dimension_cells

OVERALL = "overall"


@dataclass(frozen=True)
class Pick:
    """How a category is chosen: highest_rate, lowest_rate, highest_volume, largest_value,
    smallest_value or value. Equal candidates go to the smaller label."""

    how: str
    value: object = None
    minimum_rows: int = 0
    excluded: tuple = ()

    def key(self) -> Column:
        """Sort key whose smallest value is the pick; NULL for categories that do not qualify."""
        number = F.col("category").try_cast("double")
        size = {
            "highest_rate": -F.col("rate_percent"),
            "lowest_rate": F.col("rate_percent"),
            "highest_volume": -F.col("total"),
            "largest_value": -number,
            "smallest_value": number,
            "value": F.lit(0),
        }[self.how]
        eligible = F.col("total") >= self.minimum_rows
        if self.how == "value":
            eligible = eligible & (F.col("category") == str(self.value))
        if self.excluded:
            eligible = eligible & ~F.col("category").isin(*[str(v) for v in self.excluded])
        return F.when(eligible, F.struct(size.cast("double").alias("size"), F.col("category")))


@dataclass(frozen=True)
class Contrast:
    """Focal category against a reference; without a reference it is a data-quality row."""

    dimension: str
    focal: Pick
    reference: Pick | None
    priority: str = "secondary"
    #: An optional contrast is left out when its category does not occur.
    optional: bool = False


def category_evidence(
    df: DataFrame, dimensions: Sequence[str], flag: str = "flag", period: str = "period"
) -> DataFrame:
    """Per dimension and category: total, rate, and the spread of its per-period rate.

    All dimensions share one scan and one shuffle of (dimension, category, period) cells.
    """
    return evidence_from_cells(dimension_cells(df, {d: d for d in dimensions}, flag, period))


def evidence_from_cells(cells: DataFrame) -> DataFrame:
    """``category_evidence`` of ``dimension_cells``."""
    rate = percent("flagged", cell_total())
    total, flagged = F.sum(cell_total()), F.sum("flagged")
    low, high = F.min(rate), F.max(rate)
    return cells.groupBy("dimension", "category").agg(
        total.alias("total"),
        percent(flagged, total).alias("rate_percent"),
        F.count(F.lit(1)).alias("periods_observed"),
        low.alias("minimum_rate_percent"),
        high.alias("maximum_rate_percent"),
        F.round(high - low, 6).alias("range_points"),
    )


def contrast_matrix(
    df: DataFrame,
    contrasts: Sequence[Contrast],
    flag: str = "flag",
    period: str = "period",
    minimum_rows: int = MINIMUM_ROWS,
    overall: bool = False,
) -> DataFrame:
    """One row per contrast. A contrast whose category does not occur fails the query.

    ``overall`` adds the row of ``global_row``; the whole table is one more category of the pass.
    """
    dimensions = list(dict.fromkeys(c.dimension for c in contrasts))
    if overall:
        df = df.withColumn(OVERALL, F.lit("all"))
        dimensions.append(OVERALL)
    evidence = category_evidence(df, dimensions, flag, period)
    return matrix_from_evidence(evidence, contrasts, minimum_rows, overall)


def matrix_from_evidence(
    evidence: DataFrame,
    contrasts: Sequence[Contrast],
    minimum_rows: int = MINIMUM_ROWS,
    overall: bool = False,
) -> DataFrame:
    """``contrast_matrix`` of category evidence; repeated contrasts are listed once."""
    fields = [
        "category",
        "total",
        "rate_percent",
        "periods_observed",
        "minimum_rate_percent",
        "maximum_rate_percent",
        "range_points",
    ]
    row = F.struct(*fields)
    picks = []
    for i, c in enumerate(contrasts):
        here = F.col("dimension") == c.dimension
        picks.append(F.min_by(row, F.when(here, c.focal.key())).alias(f"f{i}"))
        if c.reference is not None:
            picks.append(F.min_by(row, F.when(here, c.reference.key())).alias(f"r{i}"))
    rows = [_row(i, c, minimum_rows) for i, c in enumerate(contrasts)]
    if overall:
        everything = F.when(F.col("dimension") == OVERALL, row)
        picks.append(F.max(everything).alias("g"))
        g = F.col("g")
        rows.append(
            _overall_row(
                g["total"],
                g["minimum_rate_percent"],
                g["maximum_rate_percent"],
                g["range_points"],
                g["periods_observed"],
            )
        )
    matrix = evidence.agg(*picks).select(F.inline(F.array(*rows)))
    if any(c.optional for c in contrasts):
        found = F.col("focal_category").isNotNull()
        matrix = matrix.where(found).dropDuplicates(["dimension", "comparison"])
    return matrix


def _row(i: int, c: Contrast, minimum_rows: int) -> Column:
    f = F.col(f"f{i}")
    absent = F.raise_error(F.lit(f"no category for contrast {i} of {c.dimension}"))
    if c.optional:
        absent = F.lit(None).cast("string")
    focal = F.coalesce(f["category"], absent)
    if c.reference is None:
        label = F.concat(focal, F.lit(" (special category)"))
        reference, r_total, r_rate, gap, sample = [F.lit(None)] * 4 + [F.lit("data_quality")]
    else:
        r = F.col(f"r{i}")
        reference = F.coalesce(r["category"], absent)
        label = F.concat(focal, F.lit(" vs "), reference)
        r_total, r_rate = r["total"], r["rate_percent"]
        gap = point_gap(f["rate_percent"], r["rate_percent"])
        sample = F.when(
            F.least(f["total"], r["total"]) >= minimum_rows, "sufficient"
        ).otherwise("small_sample")
    return F.struct(
        F.lit(c.dimension).alias("dimension"),
        label.alias("comparison"),
        focal.alias("focal_category"),
        f["total"].alias("total"),
        f["rate_percent"].alias("rate_percent"),
        reference.cast("string").alias("reference_category"),
        r_total.cast("bigint").alias("reference_total"),
        r_rate.cast("double").alias("reference_rate_percent"),
        gap.cast("double").alias("difference_points"),
        f["periods_observed"].alias("periods_observed"),
        f["minimum_rate_percent"].alias("minimum_rate_percent"),
        f["maximum_rate_percent"].alias("maximum_rate_percent"),
        f["range_points"].alias("range_points"),
        sample.alias("sample_flag"),
        F.lit(c.priority).alias("priority"),
        F.lit(c.reference is not None).alias("substantive"),
    )


def contrast(
    df: DataFrame,
    dimension: str,
    focal,
    reference,
    flag: str = "flag",
    period: str = "period",
    minimum_rows: int = MINIMUM_ROWS,
) -> DataFrame:
    """A single contrast of two named categories; only their rows are read past the scan."""
    wanted = df.where(F.col(dimension).isin(focal, reference))
    spec = Contrast(dimension, Pick("value", focal), Pick("value", reference))
    return contrast_matrix(wanted, [spec], flag, period, minimum_rows)


def quality_rows(
    df: DataFrame, special: dict[str, object], flag: str = "flag", period: str = "period"
) -> DataFrame:
    """Matrix rows of special categories, which have no reference."""
    specs = [Contrast(d, Pick("value", v), None, "data quality") for d, v in special.items()]
    return contrast_matrix(df, specs, flag, period)


def global_row(by_period: DataFrame) -> DataFrame:
    """Highest against lowest period rate of the whole table as a matrix row."""
    low, high = F.min("rate_percent"), F.max("rate_percent")
    return by_period.agg(
        F.sum("total").alias("total"),
        low.alias("low"),
        high.alias("high"),
        F.round(high - low, 6).alias("gap"),
        F.count(F.lit(1)).alias("periods"),
    ).select(
        F.inline(F.array(_overall_row(*map(F.col, ("total", "low", "high", "gap", "periods")))))
    )


def _overall_row(total: Column, low: Column, high: Column, gap: Column, periods: Column) -> Column:
    return F.struct(
        F.lit(OVERALL).alias("dimension"),
        F.lit("highest period rate vs lowest period rate").alias("comparison"),
        F.lit("highest period rate").alias("focal_category"),
        total.alias("total"),
        high.alias("rate_percent"),
        F.lit("lowest period rate").alias("reference_category"),
        F.lit(None).cast("bigint").alias("reference_total"),
        low.alias("reference_rate_percent"),
        gap.alias("difference_points"),
        periods.alias("periods_observed"),
        low.alias("minimum_rate_percent"),
        high.alias("maximum_rate_percent"),
        gap.alias("range_points"),
        F.lit("whole_table").alias("sample_flag"),
        F.lit("contextual").alias("priority"),
        F.lit(True).alias("substantive"),
    )


def core_findings(matrix: DataFrame, priority: str = "central") -> DataFrame:
    return matrix.where(F.col("priority") == priority).orderBy(
        F.col("difference_points").desc_nulls_last(), "dimension"
    )


def consistency(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("substantive") & F.col("periods_observed").isNotNull()).select(
        "dimension",
        "comparison",
        "periods_observed",
        "minimum_rate_percent",
        "maximum_rate_percent",
        "range_points",
        "priority",
    )

"""Report tables made from other results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import map_strict, percent
from ratescope.operators.rates import cell_total, grand_total, tally


def population_table(df: DataFrame, flag: str = "flag", period: str = "period") -> DataFrame:
    """Period rows and a total row (period NULL) with share and change against the period before.

    The total row adds up the same shuffled cells; the ordered window sees one row per period.
    """
    cells = tally(df, period, flag)
    total = cells.agg(F.sum("flagged").alias("flagged"), F.sum("unflagged").alias("unflagged"))
    before = F.lag("total").over(Window.orderBy(period))

    def measured(table: DataFrame, scope: str, at_period: Column) -> DataFrame:
        return table.select(
            F.lit(scope).alias("scope"),
            at_period.alias(period),
            cell_total().alias("total"),
            "flagged",
            "unflagged",
            percent("flagged", cell_total()).alias("rate_percent"),
            percent(cell_total(), grand_total(cells)).alias("share_percent"),
        )

    changed = measured(cells, "period", F.col(period)).withColumn(
        "change_percent", F.round((F.col("total") / before - 1) * 100, 6)
    )
    last = measured(total, "total", F.lit(None).cast(df.schema[period].dataType))
    return changed.unionByName(last, allowMissingColumns=True)


def final_period_table(comparison: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """The listed metrics of development against final, under their display labels."""
    return comparison.where(F.col("metric").isin(*labels)).withColumn(
        "label", map_strict(dict(labels), "metric", "metric")
    )


def labelled_fold_metrics(metrics: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """All fold metrics with the display name of each run."""
    return metrics.withColumn("label", map_strict(dict(labels), "run", "run"))

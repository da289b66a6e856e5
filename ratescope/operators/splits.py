"""Expanding-window splits by period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratescope.functions import percent
from ratescope.operators.rates import cell_total, tally


@dataclass(frozen=True)
class Fold:
    fold: int
    train: tuple[int, ...]
    validation: int


def expanding_folds(periods: Sequence[int]) -> list[Fold]:
    """Fold k trains on the first k periods and validates on the one after them."""
    ordered = sorted(periods)
    return [Fold(k, tuple(ordered[:k]), ordered[k]) for k in range(1, len(ordered))]


def fold_periods(spark: SparkSession, folds: Sequence[Fold], period: str = "period") -> DataFrame:
    """(fold, side, period): one row per period a fold uses."""
    rows = [(f.fold, "train", p) for f in folds for p in f.train]
    rows += [(f.fold, "validation", f.validation) for f in folds]
    return spark.createDataFrame(rows, f"fold int, side string, {period} int")


def split_errors(folds: Sequence[Fold], development: Sequence[int], final: int) -> list[str]:
    """Breaches of the time order and of coverage; needs no data."""
    found = []
    for f in folds:
        used = (*f.train, f.validation)
        if not f.train or max(f.train) >= f.validation:
            found.append(f"fold {f.fold}: a training period is not before the validated one")
        if final in used:
            found.append(f"fold {f.fold}: the final period is used")
        if not set(used) <= set(development):
            found.append(f"fold {f.fold}: a period is outside development")
    if [f.validation for f in folds] != sorted(development)[1:]:
        found.append("validated periods are not each development period after the first, once")
    if len({f.fold for f in folds}) != len(folds):
        found.append("fold numbers repeat")
    return found


def check_folds(
    df: DataFrame,
    folds: Sequence[Fold],
    development: Sequence[int],
    final: int,
    key_id: str,
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """(check, violations) for ids, flags, periods and the overlap of sides.

    An id's periods are few, so one grouping by id answers all overlap questions.
    """
    known = [*development, final]
    per_id = df.groupBy(key_id).agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(period).alias("periods"),
        F.count_if(F.col(flag).isNull()).alias("flag_null"),
        F.count_if(~F.col(period).isin(*known)).alias("other_period"),
    )

    def touches(periods):
        return F.arrays_overlap("periods", F.array(*[F.lit(p) for p in periods]))

    counted = per_id.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_ids"),
        F.coalesce(F.sum("flag_null"), F.lit(0)).alias("flag_null"),
        F.coalesce(F.sum("other_period"), F.lit(0)).alias("rows_outside_partitions"),
        F.count_if(touches(development) & touches([final])).alias("ids_in_development_and_final"),
        *[
            F.count_if(touches(f.train) & touches([f.validation])).alias(
                f"fold_{f.fold}_ids_in_both_sides"
            )
            for f in folds
        ],
        F.lit(len(split_errors(folds, development, final))).cast("bigint").alias("split_errors"),
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in counted.columns]
    )
    return counted.select(F.inline(rows))


def partition_summary(
    df: DataFrame,
    folds: Sequence[Fold],
    development: Sequence[int],
    final: int,
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """Rows, flagged rows and rate per period, main partition and fold side.

    The table is scanned once; all partitions are sums of its per-period counts.
    """
    parts = [(f"period_{p}", "annual", p) for p in (*development, final)]
    parts += [("development", "development", p) for p in development]
    parts += [("final", "final_evaluation", final)]
    for f in folds:
        parts += [(f"fold_{f.fold}_train", "fold_train", p) for p in f.train]
        parts += [(f"fold_{f.fold}_validation", "fold_validation", f.validation)]
    spec = df.sparkSession.createDataFrame(
        parts, f"partition_id string, partition_role string, {period} int"
    )
    return (
        tally(df, period, flag)
        .join(spec, period)
        .groupBy("partition_id", "partition_role")
        .agg(
            F.concat_ws(
                ",", F.array_sort(F.collect_list(period)).cast("array<string>")
            ).alias("periods"),
            F.sum(cell_total()).alias("total"),
            F.sum("flagged").alias("flagged"),
            F.sum("unflagged").alias("unflagged"),
        )
        .withColumn("rate_percent", percent("flagged", "total"))
    )


def fold_table(
    df: DataFrame, folds: Sequence[Fold], flag: str = "flag", period: str = "period"
) -> DataFrame:
    """One row per fold with size, flagged rows and rate of both sides."""
    joined = tally(df, period, flag).join(fold_periods(df.sparkSession, folds, period), period)

    def side(name, value):
        return F.sum(F.when(F.col("side") == name, value))

    train_periods = F.array_sort(F.collect_list(F.when(F.col("side") == "train", F.col(period))))
    return (
        joined.groupBy("fold")
        .agg(
            F.concat_ws(",", train_periods.cast("array<string>")).alias("train_periods"),
            F.max(F.when(F.col("side") == "validation", F.col(period))).alias("validation_period"),
            side("train", cell_total()).alias("train_rows"),
            side("validation", cell_total()).alias("validation_rows"),
            side("train", F.col("flagged")).alias("train_flagged"),
            side("validation", F.col("flagged")).alias("validation_flagged"),
        )
        .withColumns(
            {
                "train_rate_percent": percent("train_flagged", "train_rows"),
                "validation_rate_percent": percent("validation_flagged", "validation_rows"),
            }
        )
    )

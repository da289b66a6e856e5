"""Evaluation of a score table: a boolean flag, a score in 0–1, and optional groups.

Everything starts from one grouping by score. The distinct scores are settled once; ranking
measures then need running totals over them, which ``running_totals`` computes range by range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import count_below, demand, in_unit_interval, outcome_label, ratio_or_zero
from ratescope.operators.statistics import (
    ROWS_PER_RANGE,
    frequency_cells,
    quantile_table,
    running_totals,
)
from ratescope.runtime import settle

# Fixed value: number of calibration bins.
CALIBRATION_BINS = 10


def checked_scores(df: DataFrame, flag: str = "flag", score: str = "score") -> DataFrame:
    """``df`` itself; a NULL flag, or a score that is NULL, not finite or outside 0–1, fails the query.

    Stands in front of every operator here, so bad rows neither count nor vanish at any table size.
    """
    good = F.col(flag).isNotNull() & in_unit_interval(score)
    return df.where(demand(good, "flag is NULL or score is not in 0-1"))


def score_cells(
    df: DataFrame, flag: str = "flag", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """(by…, score, pos, neg): flagged and unflagged rows per distinct score, settled."""
    # Adding 0.0 turns -0.0 into 0.0, so both are the same score.
    return settle(
        checked_scores(df, flag, score).groupBy(*by, (F.col(score).cast("double") + F.lit(0.0)).alias("score")).agg(
            F.count_if(F.col(flag)).alias("pos"), F.count_if(~F.col(flag)).alias("neg")
        )
    )


def score_curve(
    cells: DataFrame, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Cells plus true and false positives when the cell's score is the threshold (``cum_pos``,
    ``cum_neg``)."""
    return running_totals(cells, "score", ["pos", "neg"], by, True, rows_per_range)


# --- aggregates over the curve ---------------------------------------------------------------


def average_precision() -> Column:
    """Σ (recall step) · precision over distinct scores, highest first; 0 without flagged rows."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return ratio_or_zero(F.sum(F.col("pos") * precision), F.sum("pos"))


def roc_auc() -> Column:
    """Share of (flagged, unflagged) pairs ranked right, ties counting half."""
    right = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2)
    return F.try_divide(F.sum(right), F.sum("pos").cast("double") * F.sum("neg"))


def brier() -> Column:
    """Mean squared difference of score and flag."""
    p = F.col("score")
    return F.sum(F.col("pos") * (p - 1) * (p - 1) + F.col("neg") * p * p) / F.sum(
        F.col("pos") + F.col("neg")
    )


def confusion(threshold: float | Column) -> dict[str, Column]:
    """tn, fp, fn, tp, precision, recall, f1 at a threshold; undefined ratios are 0."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    yes = F.col("score") >= t
    tp = F.coalesce(F.sum(F.when(yes, F.col("pos"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(yes, F.col("neg"))), F.lit(0))
    fn, tn = F.sum("pos") - tp, F.sum("neg") - fp
    return {
        "tn": tn,
        "fp": fp,
        "fn": fn,
        "tp": tp,
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    }


def probability_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, flagged share, average precision, ROC-AUC and Brier score per group."""
    rows = F.sum(F.col("pos") + F.col("neg"))
    return curve.groupBy(*by).agg(
        rows.alias("rows"),
        (F.sum("pos") / rows).alias("positive_rate"),
        average_precision().alias("average_precision"),
        roc_auc().alias("roc_auc"),
        brier().alias("brier_score"),
    )


def fold_metrics(
    df: DataFrame,
    flag: str = "flag",
    score: str = "score",
    by: Sequence[str] = ("fold",),
    threshold: float = 0.5,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """All measures per fold in one aggregation over the curve."""
    curve = score_curve(score_cells(df, flag, score, by), by, rows_per_range)
    rows = F.sum(F.col("pos") + F.col("neg"))
    return curve.groupBy(*by).agg(
        rows.alias("rows"),
        (F.sum("pos") / rows).alias("positive_rate"),
        average_precision().alias("average_precision"),
        roc_auc().alias("roc_auc"),
        brier().alias("brier_score"),
        *[c.alias(name) for name, c in confusion(float(threshold)).items()],
    )


def best_f1_threshold(
    df: DataFrame,
    flag: str = "flag",
    score: str = "score",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Every distinct score is a candidate: highest F1, then higher recall, then lower score.

    F1 is the fraction 2·TP / (P + TP + FP) of integers. Two fractions are compared by their first
    36 decimal digits, as two long-division steps of 18 digits; unequal fractions of counts up to
    10^17 differ within those digits, so the comparison is exact.
    """
    cells = score_cells(df, flag, score)
    positives = cells.agg(F.sum("pos")).scalar()
    negatives = cells.agg(F.sum("neg")).scalar()
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    shift = F.lit(10**18).cast("decimal(19,0)")
    top = (2 * tp).cast("decimal(18,0)")
    bottom = (positives + tp + fp).cast("decimal(18,0)")
    step = top * shift
    rest = (step % bottom).cast("decimal(18,0)") * shift
    digits = F.struct(
        ((step - step % bottom) / bottom).cast("decimal(20,0)").alias("high"),
        ((rest - rest % bottom) / bottom).cast("decimal(20,0)").alias("low"),
    )
    ranked = score_curve(cells, (), rows_per_range).select(
        F.col("score"), tp.alias("tp"), fp.alias("fp"), digits.alias("f1_digits")
    )
    best = ranked.agg(F.max("f1_digits")).scalar()
    tied = F.col("f1_digits") == best
    order = F.struct("f1_digits", "tp", (-F.col("score")).alias("s"))
    return (
        ranked.agg(
            F.count(F.lit(1)).alias("candidates"),
            F.count_if(tied).alias("candidates_at_maximum"),
            (F.min(F.when(tied, F.col("tp"))) != F.max(F.when(tied, F.col("tp")))).alias(
                "recall_decided"
            ),
            F.max_by(F.struct("score", "tp", "fp"), order).alias("best"),
        )
        .select(
            F.col("best.score").alias("threshold"),
            "candidates",
            "candidates_at_maximum",
            "recall_decided",
            # Equal F1 and equal TP mean equal FP unless TP is 0, so only then scores can tie.
            ((F.col("candidates_at_maximum") > 1) & (F.col("best.tp") == 0)).alias(
                "lower_score_decided"
            ),
            F.col("best.tp").alias("tp"),
            F.col("best.fp").alias("fp"),
            (positives - F.col("best.tp")).alias("fn"),
            (negatives - F.col("best.fp")).alias("tn"),
        )
        .withColumns(
            {
                "precision": ratio_or_zero("tp", F.col("tp") + F.col("fp")),
                "recall": ratio_or_zero("tp", F.col("tp") + F.col("fn")),
                "f1": ratio_or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
            }
        )
    )


def threshold_table(
    df: DataFrame,
    thresholds: Mapping[str, float],
    flag: str = "flag",
    score: str = "score",
    per_period: Sequence[str] = (),
    period: str = "period",
) -> DataFrame:
    """Confusion measures per named threshold over all rows (period NULL), and per period for the
    thresholds listed in ``per_period``. One grouping by period serves both."""
    yes = {n: F.col(score) >= F.lit(float(t)) for n, t in thresholds.items()}
    counts = checked_scores(df, flag, score).groupBy(period).agg(
        F.count_if(F.col(flag)).alias("p"),
        F.count_if(~F.col(flag)).alias("n"),
        *[F.count_if(y & F.col(flag)).alias(f"tp_{n}") for n, y in yes.items()],
        *[F.count_if(y & ~F.col(flag)).alias(f"fp_{n}") for n, y in yes.items()],
    )
    pooled = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != period])

    def rows(table: DataFrame, names, at_period: Column) -> DataFrame:
        each = F.array(
            *[
                F.struct(
                    F.lit(n).alias("threshold_role"),
                    F.lit(float(thresholds[n])).alias("threshold"),
                    at_period.cast("int").alias(period),
                    (F.col("n") - F.col(f"fp_{n}")).alias("tn"),
                    F.col(f"fp_{n}").alias("fp"),
                    (F.col("p") - F.col(f"tp_{n}")).alias("fn"),
                    F.col(f"tp_{n}").alias("tp"),
                )
                for n in names
            ]
        )
        return table.select(F.inline(each))

    out = rows(pooled, list(thresholds), F.lit(None))
    if per_period:
        # All roles are laid out before the choice, so both parts read the same shuffled counts.
        each = rows(counts, list(thresholds), F.col(period))
        out = out.unionByName(each.where(F.col("threshold_role").isin(*per_period)))
    return out.withColumns(
        {
            "precision": ratio_or_zero("tp", F.col("tp") + F.col("fp")),
            "recall": ratio_or_zero("tp", F.col("tp") + F.col("fn")),
            "f1": ratio_or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def calibration_table(
    df: DataFrame,
    flag: str = "flag",
    score: str = "score",
    by: Sequence[str] = (),
    bins: int = CALIBRATION_BINS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Quantile bins: rows, score span, mean score and observed rate per occupied bin.

    Borders are interpolated quantiles of the scores; a score on a border belongs to the lower bin.
    Occupied bins are numbered from 1 without gaps; each group has at most ``bins`` of them.
    """
    cells = score_cells(df, flag, score, by)
    keys = list(by)
    sizes = cells.select(
        *keys, F.col("score").alias("value"), (F.col("pos") + F.col("neg")).alias("n")
    )
    borders = {f"_q{i}": i / bins for i in range(1, bins)}
    table = quantile_table(
        sizes, keys, borders, rows_per_range=rows_per_range, measures=False
    )
    edges = table.select(*keys, F.array(*borders).alias("edges"))
    if keys:
        located = cells.join(edges, keys)
    else:
        located = cells.withColumn("edges", edges.scalar())
    n = F.col("pos") + F.col("neg")
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_bin"))
    return (
        located.withColumn("_bin", count_below(F.col("edges"), F.col("score")))
        .groupBy(*keys, "_bin")
        .agg(
            F.sum(n).alias("rows"),
            F.min("score").alias("score_min"),
            F.max("score").alias("score_max"),
            (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_score"),
            (F.sum("pos") / F.sum(n)).alias("observed_rate"),
        )
        .withColumn("bin", number)
        .select(
            *keys, "bin", "rows", "score_min", "score_max", "mean_score", "observed_rate"
        )
    )


def calibration_by_fold(
    df: DataFrame,
    flag: str = "flag",
    score: str = "score",
    fold: str = "fold",
    bins: int = CALIBRATION_BINS,
) -> DataFrame:
    return calibration_table(df, flag, score, [fold], bins).select(
        fold, "bin", "mean_score", "observed_rate"
    )


def outcome_profile(
    df: DataFrame,
    flag: str = "flag",
    decision: str = "decision",
    score: str = "score",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Rows, share and score distribution per TP, FP, FN and TN."""
    decided = demand(F.col(decision).isNotNull(), "decision is NULL")
    labelled = checked_scores(df, flag, score).where(decided).select(outcome_label(flag, decision).alias("outcome"), F.col(score).alias("score"))
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    cells = settle(frequency_cells(labelled, ["score"], ["outcome"])).drop("variable")
    profile = quantile_table(cells, ["outcome"], shares, rows_per_range=rows_per_range)
    total = cells.agg(F.sum("n")).scalar()
    return profile.withColumnRenamed("n", "rows").withColumn("share", F.col("rows") / total)

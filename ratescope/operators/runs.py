"""Comparing runs. The inputs are small result tables: one row per run and fold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.functions import demand
from ratescope.operators.joins import pair_deltas, union_strict
from ratescope.operators.ranking import minimum_rank


def run_summary(metrics: DataFrame, run: str = "run") -> DataFrame:
    """Per run: folds, plain mean and population deviation of average precision, its last fold,
    mean ROC-AUC and mean Brier score."""
    return metrics.groupBy(run).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("average_precision").alias("ap_mean"),
        F.stddev_pop("average_precision").alias("ap_deviation"),
        F.max_by("average_precision", "fold").alias("ap_last_fold"),
        F.avg("roc_auc").alias("mean_roc_auc"),
        F.avg("brier_score").alias("mean_brier_score"),
    )


def leaderboard(metrics: DataFrame, folds: Sequence[int], run: str = "run") -> DataFrame:
    """Run summary with one average-precision column per fold and ranks by three criteria."""
    wide = metrics.groupBy(run).pivot("fold", list(folds)).agg(F.first("average_precision"))
    named = wide.select(run, *[F.col(f"`{k}`").alias(f"ap_fold{k}") for k in folds])
    return minimum_rank(
        named.join(run_summary(metrics, run), run),
        {
            "mean_rank": ("ap_mean", "desc"),
            "last_fold_rank": ("ap_last_fold", "desc"),
            "deviation_rank": ("ap_deviation", "asc"),
        },
    )


def fold_comparison(runs: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Fold metrics of all runs stacked, with the run's name."""
    return union_strict(
        [table.select(F.lit(name).alias("run"), *columns) for name, table in runs.items()]
    )


def pairwise_deltas(
    board: DataFrame, pairs: Sequence[tuple[str, str]], folds: Sequence[int], run: str = "run"
) -> DataFrame:
    """Per listed pair: difference b − a of average precision per fold and of its mean."""
    return pair_deltas(board, run, pairs, [*[f"ap_fold{k}" for k in folds], "ap_mean"])


def metric_stability(metrics: DataFrame, run: str = "run") -> DataFrame:
    """Lowest, highest, spread and population deviation of average precision per run."""
    low, high = F.min("average_precision"), F.max("average_precision")
    return metrics.groupBy(run).agg(
        low.alias("ap_min"),
        high.alias("ap_max"),
        (high - low).alias("ap_range"),
        F.stddev_pop("average_precision").alias("ap_deviation"),
    )


def fold_deltas(metrics: DataFrame, run: str = "run") -> DataFrame:
    """Change of average precision from each fold to the next."""
    before = F.lag("average_precision").over(Window.partitionBy(run).orderBy("fold"))
    return metrics.select(
        run, "fold", (F.col("average_precision") - before).alias("delta")
    ).where(F.col("delta").isNotNull())


def comparable_runs(
    metrics: DataFrame, same: Sequence[str], run: str = "run", tolerance: float = 1e-12
) -> DataFrame:
    """Per fold and measure: whether all runs report it with the same value.

    Also one row per fold saying how many runs have it, to be compared with the number of runs.
    """
    runs = metrics.agg(F.count_distinct(run)).scalar()
    counted = metrics.groupBy("fold").agg(
        F.count_distinct(run).alias("runs"),
        *[(F.max(c).cast("double") - F.min(c).cast("double")).alias(c) for c in same],
    )
    rows = F.array(
        F.struct(F.lit("runs").alias("measure"), (F.col("runs") == runs).alias("agrees")),
        *[F.struct(F.lit(c).alias("measure"), (F.col(c) <= tolerance).alias("agrees")) for c in same],
    )
    return counted.select("fold", F.inline(rows))


def agreement(
    published: DataFrame, derived: DataFrame, key: Sequence[str], tolerance: float = 1e-12
) -> DataFrame:
    """(key…, measure, published, derived, agrees) for every measure that both tables have.

    A row that one table lacks has NULL there and does not agree; two NULLs do. ``key`` is unique in both.
    """
    shared = [c for c in published.columns if c in derived.columns and c not in key]
    mine = published.select(*key, F.struct(*[F.col(c).cast("double").alias(c) for c in shared]).alias("_p"))
    theirs = derived.select(*key, F.struct(*[F.col(c).cast("double").alias(c) for c in shared]).alias("_d"))
    p, d = (lambda c: F.col("_p")[c]), (lambda c: F.col("_d")[c])
    close = lambda c: p(c).eqNullSafe(d(c)) | F.coalesce(F.abs(p(c) - d(c)) <= tolerance, F.lit(False))
    both = F.col("_p").isNotNull() & F.col("_d").isNotNull()
    each = [
        F.struct(F.lit(c).alias("measure"), p(c).alias("published"), d(c).alias("derived"), (both & close(c)).alias("agrees"))
        for c in shared
    ]
    return mine.join(theirs, list(key), "full").select(*key, F.inline(F.array(*each)))


def _board_of(metrics: DataFrame, board: DataFrame, run: str) -> DataFrame:
    """The run summary that the fold rows give, with the fold columns that the board has."""
    folds = [int(c.removeprefix("ap_fold")) for c in board.columns if c.removeprefix("ap_fold").isdigit()]
    columns = [F.max(F.when(F.col("fold") == k, F.col("average_precision"))).alias(f"ap_fold{k}") for k in folds]
    summary = run_summary(metrics, run)
    return summary.join(metrics.groupBy(run).agg(*columns), run) if folds else summary


def summary_agreement(
    board: DataFrame, metrics: DataFrame, run: str = "run", tolerance: float = 1e-12
) -> DataFrame:
    """Whether every run's published summary, fold columns included, is what its fold rows give."""
    return agreement(board, _board_of(metrics, board, run), [run], tolerance)


def inconsistent(
    board: DataFrame,
    metrics: DataFrame,
    stability: DataFrame | None = None,
    deltas: DataFrame | None = None,
    run: str = "run",
    tolerance: float = 1e-12,
) -> DataFrame:
    """(table, subject, measure, published, derived): everything in the published tables that the fold rows contradict.

    The board is compared with the fold rows, the stability table (lowest, highest, spread, deviation) too, and the
    pairwise deltas with the board that the fold rows give.
    """
    derived = _board_of(metrics, board, run)

    def wrong(name: str, found: DataFrame, subject: Column) -> DataFrame:
        return found.where("NOT agrees").select(
            F.lit(name).alias("table"), subject.alias("subject"), "measure", "published", "derived"
        )

    parts = [wrong("board", agreement(board, derived, [run], tolerance), F.col(run))]
    if stability is not None:
        own = metric_stability(metrics, run)
        parts.append(wrong("stability", agreement(stability, own, [run], tolerance), F.col(run)))
    if deltas is not None:
        measures = [c.removesuffix("_delta") for c in deltas.columns if c.endswith("_delta")]
        one, two = (
            derived.select(F.col(run).alias(side), *[F.col(m).alias(f"{side}_{m}") for m in measures]) for side in "ab"
        )
        own = deltas.select("a", "b").join(one, "a").join(two, "b").select(
            "a", "b", *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"{m}_delta") for m in measures]
        )
        found = agreement(deltas, own, ["a", "b"], tolerance)
        parts.append(wrong("deltas", found, F.concat_ws(" - ", "a", "b")))
    return reduce(DataFrame.unionByName, parts)


def select_best(
    board: DataFrame,
    run: str = "run",
    measure: str = "ap_mean",
    metrics: DataFrame | None = None,
    stability: DataFrame | None = None,
    deltas: DataFrame | None = None,
    tolerance: float = 1e-12,
) -> DataFrame:
    """The single best run; an exact tie at the top fails the query.

    With the fold rows (``metrics``) it also fails where the board, or the stability table or deltas if given, contradicts
    them. Both checks are filters, so they hold whichever columns are read.
    """
    best = board.agg(F.max(measure)).scalar()
    top = board.where(F.col(measure) == best).agg(
        F.count(F.lit(1)).alias("n"), F.min(run).alias(run), F.max(measure).alias(measure)
    )
    if metrics is not None:
        wrong = inconsistent(board, metrics, stability, deltas, run, tolerance).agg(F.count(F.lit(1))).scalar()
        top = top.where(demand(wrong == 0, "published runs contradict their folds"))
    return top.where(demand(F.col("n") == 1, "no unique best run")).select(run, measure)


def development_vs_final(development: DataFrame, final: DataFrame) -> DataFrame:
    """(metric, reference, development_value, final_value, delta).

    ``development`` is (metric, reference, value), ``final`` is (metric, value).
    """
    return development.withColumnRenamed("value", "development_value").join(
        final.withColumnRenamed("value", "final_value"), "metric"
    ).withColumn("delta", F.col("final_value") - F.col("development_value"))


# What the final period is compared with: measure, column of the run summary, reference.
SUMMARY_REFERENCES = (
    ("average_precision", "ap_mean", "fold_mean"),
    ("average_precision", "ap_last_fold", "last_fold"),
    ("roc_auc", "mean_roc_auc", "fold_mean"),
    ("brier_score", "mean_brier_score", "fold_mean"),
)
DECISION_MEASURES = ("precision", "recall", "f1")


def development_comparison(
    summary: DataFrame, decisions: DataFrame, final_metrics: DataFrame, final_decisions: DataFrame
) -> DataFrame:
    """The seven comparisons of the chosen run with the final period.

    Average precision with the mean of the folds and with the last one, ROC-AUC and Brier score with their
    means; precision, recall and F1 at the frozen threshold with those of all out-of-fold rows. Each input has one
    row: the run's summary, its threshold row, the final period's probability measures and threshold row.
    """
    row = lambda metric, reference, value: F.struct(
        F.lit(metric).alias("metric"), F.lit(reference).alias("reference"), F.col(value).cast("double").alias("value")
    )
    means = summary.select(F.inline(F.array(*[row(m, ref, c) for m, c, ref in SUMMARY_REFERENCES])))
    decided = decisions.select(F.inline(F.array(*[row(m, "pooled_out_of_fold", m) for m in DECISION_MEASURES])))
    measures = ("average_precision", "roc_auc", "brier_score")
    final = long_metrics(final_metrics, measures).unionByName(long_metrics(final_decisions, DECISION_MEASURES))
    return development_vs_final(means.unionByName(decided), final)


def long_metrics(table: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, metric, value) from a wide metric table."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return table.select(*keep, F.inline(pairs))

"""Lookups of any length, token fields by their different texts, unseen categories and checks of published runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ratescope.operators import features, joins, models, rates, runs, splits, tokens


@pytest.mark.parametrize("n", [5, 100_000])
def test_lookup_of_any_length(spark, rows, n):
    df = spark.createDataFrame([(3, "a"), (n - 1, "b"), (None, "c"), (3, "d")], "k long, name string")
    mapping = {k: f"v{k}" for k in range(n)}
    got = joins.lookup(df, "k", mapping, "value")
    assert rows(got, "name", "value") == [("a", "v3"), ("b", f"v{n - 1}"), ("c", None), ("d", "v3")]
    table = spark.createDataFrame([(3, 30), (n - 1, None)], "a long, b int")
    assert rows(joins.lookup(df, "k", table, "k"), "name", "k") == [("a", 30), ("b", None), ("c", None), ("d", 30)]
    assert rows(joins.lookup(df, "k", {3: 1}, "v", default=0).where("k IS NOT NULL"), "name", "v") == [("a", 1), ("b", 0), ("d", 1)]


def test_a_missing_key_fails_whatever_is_read(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    missing = joins.lookup(df, "k", {1: "x"}, "v", what="code")
    with pytest.raises(Exception, match="unmapped code: 2"):
        missing.count()
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    with pytest.raises(Exception, match="key is not unique"):
        joins.lookup(df, "k", twice, "v").collect()


def test_orders_longer_than_a_literal(spark):
    order = [f"c{k}" for k in range(3000)]
    df = spark.createDataFrame([("c2999",), ("c5",), ("c1000",)], "c string")
    assert [r["c"] for r in rates.sort_by_order(df, "c", order).collect()] == ["c5", "c1000", "c2999"]
    with pytest.raises(Exception, match="unmapped c: c2999"):
        rates.sort_by_order(df, "c", order[:2999]).collect()


def test_only_different_texts_are_taken_apart(spark, rows):
    df = spark.createDataFrame([("a;b", True), ("a;b", False), ("b;b", True), (None, True), ("", False)], "t string, flag boolean")
    cells = tokens.token_cells(df, "t")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("partial_count")
    want = [(None, 1, 0, 1), ("a", 1, 1, 2), ("b", 2, 1, 1)]
    got = rows(cells.where("token <> '' OR token IS NULL"), "token", "flagged", "unflagged", "starts")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert cells.agg(F.sum("starts")).first()[0] == 5


def test_combinations_give_the_rows_with_unseen_values(spark, rows):
    data = [(2021, "a", "x"), (2022, "b", "y"), (2022, "b", "y"), (2022, None, "x"), (2022, "a", "x"), (2023, "a", "x"), (2023, "c", "q")]
    df = spark.createDataFrame(data, "period int, u string, w string")
    folds = splits.expanding_folds([2021, 2022, 2023])
    cells = features.fold_cells(df, ["u", "w"], folds)
    counts = features.combination_counts(df, ["u", "w"])
    weighted = features.fold_cells(counts, ["u", "w"], folds, weight="n")
    assert rows(cells) == rows(weighted)
    for found in (
        features.rows_with_any_unknown(df, cells, ["u", "w"], folds),
        features.rows_with_any_unknown(counts, weighted, ["u", "w"], folds, weight="n"),
    ):
        assert rows(found) == [(1, 3), (2, 1)]
    recipe = features.Recipe(("u", "w"), (), ())
    plan = features.fold_preprocessing_summary(df, recipe, folds)
    assert rows(plan, "fold", "train_rows", "validation_rows", "rows_with_any_unknown") == [(1, 1, 4, 3), (2, 5, 2, 1)]


def test_folds_of_values_need_no_join(spark, rows):
    data = [(2021, "a"), (2022, "b"), (2022, None), (2022, "b"), (2023, "c"), (2023, "a"), (2030, "d"), (None, "e")]
    df = spark.createDataFrame(data, "period int, u string")
    folds = [splits.Fold(1, (2021,), 2022), splits.Fold(2, (2021, 2022), 2023), splits.Fold(7, (2021, 2023), 2022)]
    cells = features.fold_cells(df, ["u"], folds)
    first = [(1, "u", "<NULL>", 0, 1), (1, "u", "a", 1, 0), (1, "u", "b", 0, 2)]
    second = [(2, "u", "<NULL>", 1, 0), (2, "u", "a", 1, 1), (2, "u", "b", 2, 0), (2, "u", "c", 0, 1)]
    third = [(7, "u", "<NULL>", 0, 1), (7, "u", "a", 2, 0), (7, "u", "b", 0, 2), (7, "u", "c", 1, 0)]
    assert rows(cells) == sorted(first + second + third, key=repr)
    # a join by period deals all values to as many tasks as there are periods
    assert "Join" not in cells._jdf.queryExecution().executedPlan().toString()


def test_frequent_unseen_values_are_not_dealt_by_value(spark, rows):
    data = [(2021, "a", "w0")] * 10 + [(2022, "hot", f"w{k}") for k in range(300)] + [(2022, "a", f"w{k % 2}") for k in range(400)]
    df = spark.createDataFrame(data, "period int, u string, w string")
    folds = splits.expanding_folds([2021, 2022])
    cells = features.fold_cells(df, ["u", "w"], folds)
    found = features.rows_with_any_unknown(df, cells, ["u", "w"], folds)
    assert rows(found) == [(1, 500)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the frequent ones are marked by a broadcast list before the rest is joined by value; no join by period
    assert "LeftOuter, BuildRight" in plan and "SortMergeJoin [period" not in plan


METRICS = "run string, fold int, rows long, average_precision double, roc_auc double, brier_score double"


@pytest.fixture(scope="module")
def folds_of_runs(spark):
    data = [(run, k, 10, ap + k / 10, 0.6, 0.2) for run, ap in (("a", 0.2), ("b", 0.3)) for k in (1, 2, 3)]
    return spark.createDataFrame(data, METRICS)


def test_published_runs_that_agree(folds_of_runs, rows):
    board = runs.leaderboard(folds_of_runs, [1, 2, 3])
    deltas = runs.pairwise_deltas(board, [("a", "b")], [1, 2, 3])
    stability = runs.metric_stability(folds_of_runs)
    assert all(r["agrees"] for r in runs.summary_agreement(board, folds_of_runs).collect())
    assert runs.inconsistent(board, folds_of_runs, stability, deltas).count() == 0
    assert runs.select_best(board, metrics=folds_of_runs, stability=stability, deltas=deltas).first()["run"] == "b"


def test_published_runs_that_do_not_agree(folds_of_runs, rows):
    board = runs.leaderboard(folds_of_runs, [1, 2, 3])
    changed = board.withColumn("ap_mean", F.when(F.col("run") == "a", 0.9).otherwise(F.col("ap_mean")))
    found = runs.inconsistent(changed, folds_of_runs)
    assert [(r["table"], r["subject"], r["measure"], r["published"]) for r in found.collect()] == [("board", "a", "ap_mean", 0.9)]
    with pytest.raises(Exception, match="contradict"):
        runs.select_best(changed, metrics=folds_of_runs).select("ap_mean").collect()
    wrong = runs.metric_stability(folds_of_runs).withColumn("ap_range", F.lit(0.0))
    assert {r["measure"] for r in runs.inconsistent(board, folds_of_runs, wrong).collect()} == {"ap_range"}
    deltas = runs.pairwise_deltas(board, [("a", "b")], [1, 2, 3]).withColumn("ap_fold2_delta", F.lit(1.0))
    assert [(r["subject"], r["measure"]) for r in runs.inconsistent(board, folds_of_runs, deltas=deltas).collect()] == [("a - b", "ap_fold2_delta")]
    lacking = runs.summary_agreement(board.where("run = 'a'"), folds_of_runs).where("NOT agrees")
    assert {r["run"] for r in lacking.collect()} == {"b"}


def test_a_tie_fails_whatever_is_read(spark):
    board = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "run string, ap_mean double")
    with pytest.raises(Exception, match="no unique best run"):
        runs.select_best(board).select("ap_mean").collect()


def test_seven_comparisons(spark, folds_of_runs, rows):
    summary = runs.run_summary(folds_of_runs).where("run = 'b'")
    decided = spark.createDataFrame([(0.3, 0.7, 0.4)], "precision double, recall double, f1 double")
    measures = spark.createDataFrame([(0.55, 0.65, 0.25)], "average_precision double, roc_auc double, brier_score double")
    later = spark.createDataFrame([(0.2, 0.8, 0.3)], "precision double, recall double, f1 double")
    got = {(r["metric"], r["reference"]): (round(r["development_value"], 9), r["final_value"], round(r["delta"], 9)) for r in runs.development_comparison(summary, decided, measures, later).collect()}
    assert got == {
        ("average_precision", "fold_mean"): (0.5, 0.55, 0.05),
        ("average_precision", "last_fold"): (0.6, 0.55, -0.05),
        ("roc_auc", "fold_mean"): (0.6, 0.65, 0.05),
        ("brier_score", "fold_mean"): (0.2, 0.25, 0.05),
        ("precision", "pooled_out_of_fold"): (0.3, 0.2, -0.1),
        ("recall", "pooled_out_of_fold"): (0.7, 0.8, 0.1),
        ("f1", "pooled_out_of_fold"): (0.4, 0.3, -0.1),
    }


def test_a_bad_probability_fails_where_it_is_not_read(spark):
    class Fixed:
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector

            return df.withColumn("probability", array_to_vector(F.array(1 - F.col("p"), F.col("p"))))

    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, p double")
    with pytest.raises(Exception, match="probability out of range"):
        models.score(Fixed(), df, ["id"]).select("id").collect()

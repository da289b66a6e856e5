"""Classifiers on line items. Sizes are small here; the operators' defaults are the full settings.

Where the fitted numbers depend on the optimiser, the query returns what must hold for any fit.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope.operators import explain, features, models, scores, splits
from ratescope.plans.registry import query
from ratescope.plans.tables import DEVELOPMENT, FINAL, OCC, occurrences
from ratescope.runtime import scratch_path, settle

RECIPE = features.Recipe(
    ("l_returnflag", "l_linestatus", "month_name"), ("l_quantity",), ("late_line",)
)
KEEP = ["l_orderkey", "l_linenumber"]
FOLDS = splits.expanding_folds(DEVELOPMENT)
forest = partial(models.fit_forest, trees=10, depth=5)
boosted = partial(models.fit_boosted, rounds=8, rate=0.2, depth=4)


def rows(spark, folder):
    columns = [*KEEP, "period", "flag", *RECIPE.predictors]
    derived = occurrences(spark, folder).withColumns(
        {
            "month_name": fx.month_name("l_shipdate"),
            "late_line": (F.col("l_linenumber") > 5).cast("int"),
        }
    )
    return derived.select(*columns)


def _train(spark, folder):
    return rows(spark, folder).where(F.col("period") < 2000)


def _validation(spark, folder):
    return rows(spark, folder).where(F.col("period") == 2000)


def _quality(scored, by=()):
    """Rows, and whether the score ranks better than chance and stays within 0–1."""
    scored = settle(scored.select(*by, "flag", "score"))
    curve = scores.score_curve(scores.score_cells(scored, by=by), by)
    metrics = scores.probability_metrics(curve, by)
    spread = scored.groupBy(*by).agg(F.count_if(fx.in_unit_interval("score")).alias("in_range"))
    better = F.col("average_precision") > F.col("positive_rate")
    joined = metrics.join(spread, list(by)) if by else metrics.withColumn(
        "in_range", spread.scalar()
    )
    return joined.select(*by, "rows", "in_range", better.alias("beats_chance"))


@query(
    "fit_logistic",
    f"""WITH {OCC}, tr AS (SELECT *, monthname(l_shipdate) AS month_name FROM occ WHERE period < 2000),
n AS (SELECT DISTINCT 'l_returnflag' AS predictor, l_returnflag AS level FROM tr
  UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM tr UNION ALL SELECT DISTINCT 'month_name', month_name FROM tr)
SELECT predictor, level, NULL::BOOLEAN AS raises FROM n UNION ALL SELECT 'l_quantity', '', true UNION ALL SELECT 'late_line', '', NULL""",
)
def fit_logistic(spark, folder):
    """One coefficient per feature; more quantity must raise the odds."""
    train = _train(spark, folder)
    model = models.fit_logistic(train, RECIPE)
    weights = [(i, float(w)) for i, w in enumerate(model.stages[-1].coefficients)]
    named = features.feature_map(model.transform(train), RECIPE).join(
        spark.createDataFrame(weights, "index int, weight double"), "index"
    )
    raises = F.when(F.col("predictor") == "l_quantity", F.col("weight") > 0)
    return named.select("predictor", "level", raises.alias("raises"))


@query("fit_forest")
def fit_forest(spark, folder):
    statistics = models.forest_statistics(forest(_train(spark, folder), RECIPE))
    return spark.createDataFrame([statistics])


@query(
    "fit_boosted",
    f"WITH {OCC} SELECT count(*) AS rows, count(*) AS in_range, true AS beats_chance FROM occ WHERE period = 2000",
)
def fit_boosted(spark, folder):
    model = boosted(_train(spark, folder), RECIPE)
    return _quality(models.score(model, _validation(spark, folder), ["flag"]))


@query(
    "score_forest",
    f"WITH {OCC} SELECT count(*) AS rows, count(*) AS in_range, true AS beats_chance FROM occ WHERE period = 2000",
)
def score_forest(spark, folder):
    model = forest(_train(spark, folder), RECIPE)
    return _quality(models.score(model, _validation(spark, folder), ["flag"]))


@query("score")
def score(spark, folder):
    model = models.fit_logistic(_train(spark, folder), RECIPE)
    return models.score(model, _validation(spark, folder), [*KEEP, "flag"])


@query(
    "out_of_fold",
    f"""WITH {OCC} SELECT period - 1995 AS fold, count(*) AS rows, count(*) AS in_range, true AS beats_chance
FROM occ WHERE period BETWEEN 1996 AND 2000 GROUP BY 1""",
)
def out_of_fold(spark, folder):
    table = rows(spark, folder)
    return _quality(models.out_of_fold(table, FOLDS, RECIPE, models.fit_logistic, KEEP), ["fold"])


def _saved(spark, folder, fit):
    path = scratch_path(spark, "model")
    model = models.refit_all_development(rows(spark, folder), DEVELOPMENT, RECIPE, fit, path)
    return path, model


@query("refit_all_development")
def refit_all_development(spark, folder):
    """Features of the model read back from disk."""
    _, model = _saved(spark, folder, models.fit_logistic)
    return features.feature_map(model.transform(rows(spark, folder)), RECIPE)


@query(
    "score_holdout",
    f"WITH {OCC} SELECT period, count(*) AS rows, count(*) AS in_range FROM occ WHERE period = 2001 GROUP BY 1",
)
def score_holdout(spark, folder):
    path, _ = _saved(spark, folder, models.fit_logistic)
    scored = models.score_holdout(path, rows(spark, folder), FINAL, 0.3, KEEP)
    agrees = F.col("decision") == (F.col("score") >= 0.3)
    return scored.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(fx.in_unit_interval("score") & agrees).alias("in_range"),
    )


def explained(spark, folder):
    model = boosted(_train(spark, folder), RECIPE)
    final = rows(spark, folder).where(F.col("period") == FINAL)
    return model, explain.tree_contributions(model, final, ["flag"])


@query(
    "tree_contributions",
    f"WITH {OCC} SELECT count(*) AS rows, true AS additive FROM occ WHERE period = 2001",
)
def tree_contributions(spark, folder):
    """Contributions plus bias reproduce every probability within 1e-6."""
    _, table = explained(spark, folder)
    errors = explain.contribution_errors(table)
    return errors.select("rows", (F.col("maximum_error") < 1e-6).alias("additive"))


@query(
    "model_top_predictor",
    "SELECT 'l_quantity' AS predictor, 1 AS rank FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0",
)
def model_top_predictor(spark, folder):
    """The flag depends on quantity, so quantity must lead the contributions."""
    model, table = explained(spark, folder)
    names = features.feature_map(model.transform(rows(spark, folder)), RECIPE)
    ranking = explain.contribution_ranking(table, names)
    return explain.top_features(ranking, 1).select("predictor", "rank")

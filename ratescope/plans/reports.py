"""Report tables and rankings of contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope.operators import explain, report, runs
from ratescope.plans.metrics import ALL_RUNS, run_metrics
from ratescope.plans.registry import query
from ratescope.plans.tables import MEASURES, OCC, SC, occurrences, scores


@query(
    "population_table",
    f"""WITH {OCC}, p AS (SELECT period, {MEASURES} FROM occ GROUP BY 1)
SELECT 'period' AS scope, *, round(total / (SELECT count(*) FROM occ) * 100, 6) AS share_percent,
  round((total / lag(total) OVER (ORDER BY period) - 1) * 100, 6) AS change_percent FROM p
UNION ALL BY NAME SELECT 'total' AS scope, {MEASURES}, 100.0::DOUBLE AS share_percent FROM occ""",
)
def population_table(spark, folder):
    return report.population_table(occurrences(spark, folder))


@query(
    "final_period_table",
    f"""WITH {SC} SELECT 'mean' AS metric, 'Mean score' AS label,
  round((SELECT avg(score) FROM sc WHERE period <= 2000), 9) AS development_value,
  round((SELECT avg(score) FROM sc WHERE period = 2001), 9) AS final_value""",
)
def final_period_table(spark, folder):
    def side(condition):
        wide = scores(spark, folder).where(condition).agg(
            F.round(F.avg("score"), 9).alias("mean"), F.max("score").alias("highest")
        )
        return runs.long_metrics(wide, ["mean", "highest"])

    compared = runs.development_vs_final(side("period <= 2000"), side("period = 2001"))
    return report.final_period_table(compared, {"mean": "Mean score"}).drop("delta")


@query(
    "fold_metrics_table",
    f"""WITH {ALL_RUNS} SELECT *, CASE run WHEN 'plain' THEN 'Plain score' WHEN 'coarse' THEN 'Tenths' ELSE 'Blurred score' END AS label FROM m""",
)
def fold_metrics_table(spark, folder):
    labels = {"plain": "Plain score", "coarse": "Tenths", "blurred": "Blurred score"}
    return report.labelled_fold_metrics(run_metrics(spark, folder), labels)


# --- contributions ---------------------------------------------------------------------------

# Four columns of line items play the part of contributions of four features of two predictors.
FEATURES = [
    (0, "a=1", "a", "categorical", "1"),
    (1, "a=2", "a", "categorical", "2"),
    (2, "b_scaled", "b", "numeric", ""),
    (3, "c", "c", "binary", ""),
]
FEATURE_SQL = "fm AS (SELECT * FROM (VALUES " + ", ".join(str(f) for f in FEATURES) + (
    ") AS v(index, feature, predictor, predictor_group, level))"
)
LONG = f"""{OCC}, long AS (SELECT flag, l_linenumber > 4 AS decision, 0 AS index, l_discount - CAST(0.05 AS DOUBLE) AS c FROM occ
  UNION ALL SELECT flag, l_linenumber > 4, 1, l_tax - CAST(0.01 AS DOUBLE) FROM occ
  UNION ALL SELECT flag, l_linenumber > 4, 2, (l_quantity - 25) / 100 FROM occ
  UNION ALL SELECT flag, l_linenumber > 4, 3, (l_linenumber - 4) / 50 FROM occ), {FEATURE_SQL}"""
MEANS = "round(avg(abs(c)), 9) AS mean_abs, round(avg(c), 9) + 0.0::DOUBLE AS mean_signed"


def _explained(spark, folder):
    values = F.array(
        F.col("l_discount") - 0.05,
        F.col("l_tax") - 0.01,
        (F.col("l_quantity") - 25) / 100,
        (F.col("l_linenumber") - 4) / 50,
    )
    return occurrences(spark, folder).select(
        "flag", (F.col("l_linenumber") > 4).alias("decision"), values.alias("contributions")
    )


def _feature_map(spark):
    return spark.createDataFrame(
        FEATURES,
        "index int, feature string, predictor string, predictor_group string, level string",
    )


def _round(df):
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return df.withColumns({n: F.round(n, 9) + F.lit(0.0) for n in ("mean_abs", "mean_signed")})


@query(
    "row_rank",
    f"""WITH {LONG}, a AS (SELECT index, {MEANS} FROM long GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank, feature, predictor,
  predictor_group, level, mean_abs, mean_signed FROM a JOIN fm USING (index)""",
)
def feature_ranking(spark, folder):
    explained = _explained(spark, folder)
    return _round(explain.feature_ranking(explained, _feature_map(spark)))


PER_PREDICTOR = """a AS (SELECT index, avg(abs(c)) AS a, avg(c) AS s FROM long GROUP BY 1),
p AS (SELECT predictor, predictor_group, count(*) AS features, sum(a) AS x, sum(s) AS y FROM a JOIN fm USING (index) GROUP BY ALL),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY x DESC, predictor) AS INTEGER) AS rank, predictor, predictor_group, features,
  round(x, 9) AS mean_abs, round(y, 9) + 0.0::DOUBLE AS mean_signed, round(x / (SELECT sum(x) FROM p), 9) AS share FROM p)"""


@query("contribution_ranking", f"WITH {LONG}, {PER_PREDICTOR} SELECT * FROM ranked")
def contribution_ranking(spark, folder):
    explained = _explained(spark, folder)
    out = explain.contribution_ranking(explained, _feature_map(spark))
    return _round(out).withColumn("share", F.round("share", 9))


@query("top_features", f"WITH {LONG}, {PER_PREDICTOR} SELECT * FROM ranked ORDER BY rank LIMIT 2")
def top_features(spark, folder):
    return explain.top_features(contribution_ranking(spark, folder), 2)


@query(
    "contribution_by_outcome",
    f"""WITH {LONG}, o AS (SELECT CASE WHEN flag AND decision THEN 'TP' WHEN decision THEN 'FP' WHEN flag THEN 'FN' ELSE 'TN' END AS outcome, index, c FROM long),
a AS (SELECT outcome, index, count(*) AS n, avg(abs(c)) AS a, avg(c) AS s FROM o GROUP BY ALL)
SELECT predictor, outcome, max(n) AS rows, round(sum(a), 9) AS mean_abs, round(sum(s), 9) + 0.0::DOUBLE AS mean_signed
FROM a JOIN fm USING (index) GROUP BY ALL""",
)
def contribution_by_outcome(spark, folder):
    explained = _explained(spark, folder)
    return _round(explain.contribution_by_outcome(explained, _feature_map(spark)))

"""Evaluation of score tables and comparison of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope.operators import ranking, runs, scores
from ratescope.plans.registry import query
from ratescope.plans.tables import SC, SCD
from ratescope.plans.tables import scores as score_table

OOF = f"{SC}, oof AS (SELECT * FROM sc WHERE period BETWEEN 1996 AND 2000)"
CURVE = """g AS (SELECT fold, score, count(*) FILTER (WHERE flag) AS pos, count(*) FILTER (WHERE NOT flag) AS neg
  FROM oof GROUP BY ALL),
cv AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp FROM g
  WINDOW w AS (PARTITION BY fold ORDER BY score DESC))"""
AP = "round(sum(pos * (tp / (tp + fp))) / sum(pos), 9) AS average_precision"
AUC = "round(sum(neg * (tp - pos / 2)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) AS roc_auc"
BRIER = "round(sum(pos * (score - 1) ** 2 + neg * score ** 2) / sum(pos + neg), 9) AS brier_score"


def oof(spark, folder):
    return score_table(spark, folder).where("period BETWEEN 1996 AND 2000")


def _round(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def _metric(spark, folder, aggregate, name):
    curve = scores.score_curve(
        scores.score_cells(oof(spark, folder), by=["fold"]), ["fold"], rows_per_range=1_000
    )
    return curve.groupBy("fold").agg(F.round(aggregate, 9).alias(name))


@query("average_precision", f"WITH {OOF}, {CURVE} SELECT fold, {AP} FROM cv GROUP BY fold")
def average_precision(spark, folder):
    return _metric(spark, folder, scores.average_precision(), "average_precision")


@query("roc_auc", f"WITH {OOF}, {CURVE} SELECT fold, {AUC} FROM cv GROUP BY fold")
def roc_auc(spark, folder):
    return _metric(spark, folder, scores.roc_auc(), "roc_auc")


@query("brier", f"WITH {OOF}, {CURVE} SELECT fold, {BRIER} FROM cv GROUP BY fold")
def brier(spark, folder):
    return _metric(spark, folder, scores.brier(), "brier_score")


def _confusion_sql(test: str) -> str:
    tp, fp = f"count(*) FILTER (WHERE {test} AND flag)", f"count(*) FILTER (WHERE {test} AND NOT flag)"
    fn, tn = f"count(*) FILTER (WHERE NOT ({test}) AND flag)", f"count(*) FILTER (WHERE NOT ({test}) AND NOT flag)"
    return f"""{tn} AS tn, {fp} AS fp, {fn} AS fn, {tp} AS tp,
  round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 9) AS precision,
  round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 9) AS recall,
  round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 9) AS f1"""


@query(
    "confusion",
    f"WITH {OOF} SELECT {_confusion_sql('score >= CAST(0.6 AS DOUBLE)')} FROM oof",
)
def confusion(spark, folder):
    measures = scores.confusion(0.6)
    cells = scores.score_cells(oof(spark, folder))
    out = cells.agg(*[c.alias(n) for n, c in measures.items()])
    return _round(out, "precision", "recall", "f1")


FOLD_METRICS = f"""fm AS (SELECT * FROM (SELECT fold, {AP}, {AUC}, {BRIER} FROM cv GROUP BY fold)
  JOIN (SELECT fold, count(*) AS rows, round(avg(CAST(flag AS INTEGER)), 9) AS positive_rate,
    {_confusion_sql('score >= CAST(0.5 AS DOUBLE)')} FROM oof GROUP BY fold) USING (fold))"""


@query("fold_metrics", f"WITH {OOF}, {CURVE}, {FOLD_METRICS} SELECT * FROM fm")
def fold_metrics(spark, folder):
    out = scores.fold_metrics(oof(spark, folder), rows_per_range=1_000)
    names = [c for c, t in out.dtypes if t == "double"]
    return _round(out, *names)


@query(
    "best_f1_threshold",
    f"""WITH {OOF}, g AS (SELECT score, count(*) FILTER (WHERE flag) AS pos, count(*) FILTER (WHERE NOT flag) AS neg FROM oof GROUP BY 1),
c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM g),
n AS (SELECT CAST(sum(pos) AS BIGINT) AS p, CAST(sum(neg) AS BIGINT) AS q FROM g),
k AS (SELECT c.*, 2 * tp::HUGEINT AS num, p + tp::HUGEINT + fp AS den FROM c, n),
m AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.num * a.den > a.num * b.den)),
t AS (SELECT * FROM m ORDER BY tp DESC, score LIMIT 1)
SELECT t.score AS threshold, (SELECT count(*) FROM k) AS candidates, (SELECT count(*) FROM m) AS candidates_at_maximum,
  (SELECT min(tp) <> max(tp) FROM m) AS recall_decided,
  (SELECT count(*) > 1 FROM m WHERE m.tp = t.tp) AS lower_score_decided,
  t.tp, t.fp, p - t.tp AS fn, q - t.fp AS tn, round(t.tp / (t.tp + t.fp), 9) AS precision, round(t.tp / p, 9) AS recall,
  round(2 * t.tp / (p + t.tp + t.fp), 9) AS f1 FROM t, n""",
)
def best_f1_threshold(spark, folder):
    out = scores.best_f1_threshold(oof(spark, folder), rows_per_range=200)
    return _round(out, "precision", "recall", "f1")


@query(
    "threshold_table",
    f"""WITH {OOF} SELECT 'selected' AS threshold_role, CAST(0.41 AS DOUBLE) AS threshold, NULL::INTEGER AS period,
  {_confusion_sql('score >= CAST(0.41 AS DOUBLE)')} FROM oof
UNION ALL SELECT 'reference', CAST(0.5 AS DOUBLE), NULL, {_confusion_sql('score >= CAST(0.5 AS DOUBLE)')} FROM oof
UNION ALL SELECT 'selected', CAST(0.41 AS DOUBLE), period, {_confusion_sql('score >= CAST(0.41 AS DOUBLE)')} FROM oof GROUP BY period""",
)
def threshold_table(spark, folder):
    out = scores.threshold_table(
        oof(spark, folder), {"selected": 0.41, "reference": 0.5}, per_period=["selected"]
    )
    return _round(out, "precision", "recall", "f1")


EDGE_LIST = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))
BIN = "len(list_filter(edges, lambda x: x < score))"


@query(
    "calibration_by_fold",
    f"""WITH {OOF}, e AS (SELECT fold, [{EDGE_LIST}] AS edges FROM oof GROUP BY fold),
b AS (SELECT fold, {BIN} AS b, score, flag FROM oof JOIN e USING (fold))
SELECT fold, CAST(dense_rank() OVER (PARTITION BY fold ORDER BY b) AS INTEGER) AS bin, round(avg(score), 9) AS mean_score,
  round(avg(CAST(flag AS INTEGER)), 9) AS observed_rate FROM b GROUP BY fold, b""",
)
def calibration_by_fold(spark, folder):
    return _round(
        scores.calibration_by_fold(oof(spark, folder)), "mean_score", "observed_rate"
    )


@query(
    "calibration_table",
    f"""WITH {SC}, fin AS (SELECT * FROM sc WHERE period = 2001), e AS (SELECT [{EDGE_LIST}] AS edges FROM fin),
b AS (SELECT {BIN} AS b, score, flag FROM fin, e)
SELECT CAST(dense_rank() OVER (ORDER BY b) AS INTEGER) AS bin, count(*) AS rows, min(score) AS score_min, max(score) AS score_max,
  round(avg(score), 9) AS mean_score, round(avg(CAST(flag AS INTEGER)), 9) AS observed_rate FROM b GROUP BY b""",
)
def calibration_table(spark, folder):
    out = scores.calibration_table(
        score_table(spark, folder).where("period = 2001"), rows_per_range=100
    )
    return _round(out, "mean_score", "observed_rate")


@query(
    "outcome_profile",
    f"""WITH {SCD}, x AS (SELECT score, CASE WHEN flag AND decision THEN 'TP' WHEN decision THEN 'FP'
  WHEN flag THEN 'FN' ELSE 'TN' END AS outcome FROM scd)
SELECT outcome, count(*) AS rows, round(count(*) / (SELECT count(*) FROM x), 9) AS share, round(avg(score), 9) AS mean,
  round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.1), 9) AS p10,
  round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.75), 9) AS p75,
  round(quantile_cont(score, 0.9), 9) AS p90, min(score) AS minimum, max(score) AS maximum FROM x GROUP BY outcome""",
)
def outcome_profile(spark, folder):
    out = scores.outcome_profile(score_table(spark, folder))
    return _round(out, "share", "mean", "median", "p10", "p25", "p75", "p90")


# --- runs ------------------------------------------------------------------------------------

# Three runs: the score itself, a coarser one and one blurred by the order key.
RUNS = {
    "plain": ("score", "score"),
    "coarse": ("floor(score * 10) / 10", "floor(score * 10::DOUBLE) / 10::DOUBLE"),
    "blurred": (
        "(score + (o_orderkey % 13) / 13.0D) / 2",
        "(score + (o_orderkey % 13) / 13::DOUBLE) / 2::DOUBLE",
    ),
}
ALL_RUNS = f"{OOF}, r AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS run, fold, period, flag, {sql} AS s FROM oof" for name, (_, sql) in RUNS.items()
) + """), rg AS (SELECT run, fold, s, count(*) FILTER (WHERE flag) AS pos, count(*) FILTER (WHERE NOT flag) AS neg FROM r GROUP BY ALL),
rc AS (SELECT run, fold, s AS score, pos, neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp FROM rg
  WINDOW w AS (PARTITION BY run, fold ORDER BY s DESC)),
m AS (SELECT run, fold, CAST(sum(pos + neg) AS BIGINT) AS rows, round(sum(pos) / sum(pos + neg), 9) AS positive_rate, """ + f"""
  {AP}, {AUC}, {BRIER} FROM rc GROUP BY run, fold)"""
MEASURES = ["rows", "positive_rate", "average_precision", "roc_auc", "brier_score"]
FOLDS = [1, 2, 3, 4, 5]


def run_metrics(spark, folder):
    base = oof(spark, folder)
    tables = {}
    for name, (expression, _) in RUNS.items():
        scored = base.withColumn("score", F.expr(expression))
        out = scores.probability_metrics(
            scores.score_curve(scores.score_cells(scored, by=["fold"]), ["fold"]), ["fold"]
        )
        tables[name] = _round(out, "positive_rate", "average_precision", "roc_auc", "brier_score")
    return runs.fold_comparison(tables, ["fold", *MEASURES])


query("fold_comparison", f"WITH {ALL_RUNS} SELECT * FROM m")(run_metrics)

SUMMARY = """s AS (SELECT run, count(*) AS folds, avg(average_precision) AS ap_mean, stddev_pop(average_precision) AS ap_deviation,
  max_by(average_precision, fold) AS ap_last_fold, avg(roc_auc) AS mean_roc_auc, avg(brier_score) AS mean_brier_score FROM m GROUP BY run)"""
ROUNDED = "round(ap_mean, 9) AS ap_mean, round(ap_deviation, 9) AS ap_deviation, round(mean_roc_auc, 9) AS mean_roc_auc, round(mean_brier_score, 9) AS mean_brier_score"
SUMMARY_ROUND = ("ap_mean", "ap_deviation", "mean_roc_auc", "mean_brier_score")


@query("run_summary", f"WITH {ALL_RUNS}, {SUMMARY} SELECT * REPLACE ({ROUNDED}) FROM s")
def run_summary(spark, folder):
    return _round(runs.run_summary(run_metrics(spark, folder)), *SUMMARY_ROUND)


WIDE = "w AS (SELECT run, " + ", ".join(
    f"max(average_precision) FILTER (WHERE fold = {k}) AS ap_fold{k}" for k in FOLDS
) + " FROM m GROUP BY run)"


@query(
    "leaderboard",
    f"""WITH {ALL_RUNS}, {SUMMARY}, {WIDE} SELECT * REPLACE ({ROUNDED}),
  CAST(rank() OVER (ORDER BY ap_mean DESC) AS INTEGER) AS mean_rank, CAST(rank() OVER (ORDER BY ap_last_fold DESC) AS INTEGER) AS last_fold_rank,
  CAST(rank() OVER (ORDER BY ap_deviation) AS INTEGER) AS deviation_rank FROM s JOIN w USING (run)""",
)
def leaderboard(spark, folder):
    return _round(runs.leaderboard(run_metrics(spark, folder), FOLDS), *SUMMARY_ROUND)


@query(
    "criterion_ranks",
    f"""WITH {ALL_RUNS} SELECT run, fold, CAST(rank() OVER (ORDER BY brier_score) AS INTEGER) AS brier_rank,
  CAST(rank() OVER (ORDER BY rows DESC) AS INTEGER) AS size_rank FROM m""",
)
def criterion_ranks(spark, folder):
    ranked = ranking.minimum_rank(
        run_metrics(spark, folder),
        {"brier_rank": ("brier_score", "asc"), "size_rank": ("rows", "desc")},
    )
    return ranked.select("run", "fold", "brier_rank", "size_rank")


@query(
    "pairwise_deltas",
    f"""WITH {ALL_RUNS}, {SUMMARY}, {WIDE}, b AS (SELECT * FROM s JOIN w USING (run)),
p AS (SELECT * FROM (VALUES ('plain', 'coarse'), ('plain', 'blurred'), ('coarse', 'blurred')) AS v(a, b))
SELECT p.a, p.b, """
    + ", ".join(f"round(y.ap_fold{k} - x.ap_fold{k}, 9) AS ap_fold{k}_delta" for k in FOLDS)
    + ", round(y.ap_mean - x.ap_mean, 9) AS ap_mean_delta FROM p JOIN b x ON x.run = p.a JOIN b y ON y.run = p.b",
)
def pairwise_deltas(spark, folder):
    board = runs.leaderboard(run_metrics(spark, folder), FOLDS)
    pairs = [("plain", "coarse"), ("plain", "blurred"), ("coarse", "blurred")]
    out = runs.pairwise_deltas(board, pairs, FOLDS)
    return _round(out, *[c for c, t in out.dtypes if t == "double"])


@query(
    "metric_stability",
    f"""WITH {ALL_RUNS} SELECT run, min(average_precision) AS ap_min, max(average_precision) AS ap_max,
  round(max(average_precision) - min(average_precision), 9) AS ap_range, round(stddev_pop(average_precision), 9) AS ap_deviation FROM m GROUP BY run""",
)
def metric_stability(spark, folder):
    return _round(runs.metric_stability(run_metrics(spark, folder)), "ap_range", "ap_deviation")


@query(
    "fold_deltas",
    f"""WITH {ALL_RUNS}, d AS (SELECT run, fold, round(average_precision - lag(average_precision) OVER (PARTITION BY run ORDER BY fold), 9) AS delta FROM m)
SELECT * FROM d WHERE delta IS NOT NULL""",
)
def fold_deltas(spark, folder):
    return _round(runs.fold_deltas(run_metrics(spark, folder)), "delta")


@query(
    "comparable_runs",
    f"""WITH {ALL_RUNS}, n AS (SELECT count(DISTINCT run) AS k FROM m)
SELECT fold, 'runs' AS measure, count(DISTINCT run) = any_value(k) AS agrees FROM m, n GROUP BY fold
UNION ALL SELECT fold, 'rows', max(rows) = min(rows) FROM m GROUP BY fold
UNION ALL SELECT fold, 'positive_rate', max(positive_rate) = min(positive_rate) FROM m GROUP BY fold
UNION ALL SELECT fold, 'roc_auc', max(roc_auc) - min(roc_auc) <= 1e-12 FROM m GROUP BY fold""",
)
def comparable_runs(spark, folder):
    return runs.comparable_runs(run_metrics(spark, folder), ["rows", "positive_rate", "roc_auc"])


@query(
    "select_best",
    f"WITH {ALL_RUNS}, {SUMMARY} SELECT run, round(ap_mean, 9) AS ap_mean FROM s ORDER BY s.ap_mean DESC LIMIT 1",
)
def select_best(spark, folder):
    board = runs.run_summary(run_metrics(spark, folder))
    return _round(runs.select_best(board), "ap_mean")


PUBLISHED = """p AS (SELECT run, count(*) AS folds, avg(average_precision) AS ap_mean, avg(roc_auc) AS mean_roc_auc,
  avg(brier_score) AS mean_brier_score FROM m WHERE run <> 'coarse' OR fold > 1 GROUP BY run)"""


@query(
    "summary_agreement",
    f"""WITH {ALL_RUNS}, {SUMMARY}, {PUBLISHED} """
    + " UNION ALL ".join(
        f"SELECT run, '{c}' AS measure, round(p.{c}, 9) AS published, round(s.{c}, 9) AS derived, abs(p.{c} - s.{c}) <= 1e-12 AS agrees FROM p JOIN s USING (run)"
        for c in ("folds", "ap_mean", "mean_roc_auc", "mean_brier_score")
    ),
)
def summary_agreement(spark, folder):
    """Published summaries, one of which leaves out a fold, against the fold rows."""
    metrics = run_metrics(spark, folder)
    partly = runs.run_summary(metrics.where("run <> 'coarse' OR fold > 1"))
    published = partly.select("run", "folds", "ap_mean", "mean_roc_auc", "mean_brier_score")
    return _round(runs.summary_agreement(published, metrics), "published", "derived")


@query(
    "development_comparison",
    f"""WITH {ALL_RUNS}, {SUMMARY}, o AS (SELECT {_confusion_sql('score >= CAST(0.41 AS DOUBLE)')} FROM oof),
f AS (SELECT {_confusion_sql('score >= CAST(0.41 AS DOUBLE)')} FROM sc WHERE period = 2001),
final AS (SELECT average_precision, roc_auc, brier_score FROM m WHERE run = 'plain' AND fold = 1),
chosen AS (SELECT * FROM s WHERE run = 'plain'),
j AS (SELECT 'average_precision' AS metric, 'fold_mean' AS reference, ap_mean AS development_value, average_precision AS final_value FROM chosen, final
  UNION ALL SELECT 'average_precision', 'last_fold', ap_last_fold, average_precision FROM chosen, final
  UNION ALL SELECT 'roc_auc', 'fold_mean', mean_roc_auc, roc_auc FROM chosen, final
  UNION ALL SELECT 'brier_score', 'fold_mean', mean_brier_score, brier_score FROM chosen, final
  UNION ALL SELECT 'precision', 'pooled_out_of_fold', o.precision, f.precision FROM o, f
  UNION ALL SELECT 'recall', 'pooled_out_of_fold', o.recall, f.recall FROM o, f
  UNION ALL SELECT 'f1', 'pooled_out_of_fold', o.f1, f.f1 FROM o, f)
SELECT metric, reference, round(development_value, 6) AS development_value, round(final_value, 6) AS final_value,
  round(final_value - development_value, 6) AS delta FROM j""",
)
def development_comparison(spark, folder):
    """The plain run against the final period at a frozen threshold; its first fold's measures stand for the final ones."""
    metrics = run_metrics(spark, folder)
    summary = runs.run_summary(metrics).where("run = 'plain'")
    decisions = scores.threshold_table(oof(spark, folder), {"frozen": 0.41})
    final = scores.threshold_table(score_table(spark, folder).where("period = 2001"), {"frozen": 0.41})
    out = runs.development_comparison(summary, decisions, metrics.where("run = 'plain' AND fold = 1"), final)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("development_value", "final_value", "delta")})


@query(
    "development_vs_final",
    f"""WITH {SC}, dev AS (SELECT 'pooled' AS x, * FROM sc WHERE period <= 2000), fin AS (SELECT * FROM sc WHERE period = 2001),
a AS (SELECT round(avg((score - CAST(flag AS INTEGER)) ** 2), 9) AS brier_score, round(avg(CAST(flag AS INTEGER)), 9) AS positive_rate FROM dev),
b AS (SELECT round(avg((score - CAST(flag AS INTEGER)) ** 2), 9) AS brier_score, round(avg(CAST(flag AS INTEGER)), 9) AS positive_rate FROM fin)
SELECT 'brier_score' AS metric, 'development' AS reference, a.brier_score AS development_value, b.brier_score AS final_value,
  round(b.brier_score - a.brier_score, 9) AS delta FROM a, b
UNION ALL SELECT 'positive_rate', 'development', a.positive_rate, b.positive_rate, round(b.positive_rate - a.positive_rate, 9) FROM a, b""",
)
def development_vs_final(spark, folder):
    def metrics(condition):
        table = score_table(spark, folder).where(condition)
        out = scores.probability_metrics(scores.score_curve(scores.score_cells(table)))
        wide = _round(out, "brier_score", "positive_rate")
        return runs.long_metrics(wide, ["brier_score", "positive_rate"])

    development = metrics("period <= 2000").withColumn("reference", F.lit("development"))
    return _round(runs.development_vs_final(development, metrics("period = 2001")), "delta")

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratescope.operators import drift, quantiles, runs, scores, statistics
from ratescope.runtime import settle

HOT = 60  # distinct values per range in these tests, so that several ranges are used


def table(spark, values, schema):
    return spark.createDataFrame(values, schema)


@pytest.fixture(scope="module")
def sample(spark):
    """A continuous column, a tied one, and a group that holds a third of all rows in one value."""
    rng = random.Random(7)
    rows = []
    for i in range(1_500):
        hot = i % 3 == 0
        rows.append((("g1" if i % 5 else "g2"), 0.25 if hot else rng.random(), float(rng.randint(0, 9))))
    return spark.createDataFrame(rows, "g string, x double, k double"), rows


@pytest.mark.parametrize("descending", [False, True])
def test_ranges_equal_one_window(spark, sample, descending):
    df, _ = sample
    cells = settle(statistics.frequency_cells(df, ["x"], ["g"])).drop("variable")
    def run(per):
        out = statistics.running_totals(cells, "value", ["n"], ["g"], descending, per)
        return sorted((r["g"], r["value"], r["n"], r["cum_n"]) for r in out.collect())
    assert len(statistics.range_cuts(cells, "value", HOT)) > 5
    assert run(HOT) == run(10**9)


@pytest.mark.parametrize("descending", [False, True])
def test_ranges_are_cut_again_until_they_are_small(spark, monkeypatch, descending):
    rng = random.Random(3)
    values = {rng.choice([rng.random(), 1e-300 * rng.random(), -1e308 * rng.random(), 1e6 + rng.random()]) for _ in range(900)}
    cells = settle(spark.createDataFrame([("g1" if i % 4 else "g2", v, i) for i, v in enumerate(sorted(values))], "g string, value double, n long"))
    levels = []
    inside = statistics._totals_inside

    def watched(*a):
        levels.append(a[8] if len(a) > 8 else 1)
        return inside(*a)

    monkeypatch.setattr(statistics, "_totals_inside", watched)
    got = statistics.running_totals(cells, "value", ["n"], ["g"], descending, 20, 4).collect()
    assert max(levels) >= 3
    for g in ("g1", "g2"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["value"], reverse=descending)
        total = 0
        for r in mine:
            total += r["n"]
            assert r["cum_n"] == total
    assert len(got) == len(values)
    names = {"p10": 0.1, "median": 0.5}
    ones = cells.withColumn("n", F.lit(1).cast("long"))
    for r in statistics.quantile_table(ones, ["g"], names, rows_per_range=20, maximum_ranges=4).collect():
        mine = [v for i, v in enumerate(sorted(values)) if ("g1" if i % 4 else "g2") == r["g"]]
        assert r["median"] == pytest.approx(np.percentile(mine, 50)) and r["p10"] == pytest.approx(np.percentile(mine, 10))


@pytest.mark.parametrize("per_range", [HOT, 10**9])
def test_linear_quantiles_equal_numpy(sample, per_range):
    df, rows = sample
    got = statistics.numeric_summary_linear(df, ["x", "k"], ["g"], per_range).collect()
    assert len(got) == 4
    for r in got:
        values = [v[1] if r["variable"] == "x" else v[2] for v in rows if v[0] == r["g"]]
        for name, share in statistics.QUARTILES_AND_TAIL.items():
            assert r[name] == pytest.approx(np.percentile(values, share * 100), abs=1e-12)
        assert r["n"] == len(values) and r["mean"] == pytest.approx(np.mean(values))
        assert (r["minimum"], r["maximum"]) == (min(values), max(values))


@pytest.mark.parametrize("per_range", [HOT, 10**9])
def test_nearest_quantiles_come_from_the_data(sample, per_range):
    df, rows = sample
    values = sorted(v[1] for v in rows)
    r = statistics.numeric_summary_nearest(df, ["x"], per_range).first()
    for name, share in (("p25", 0.25), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)):
        assert r[name] == values[math.floor((len(values) - 1) * share + 0.5)]
    assert r["median"] == pytest.approx(np.median(values))
    assert r["rows_above_p99"] == sum(v > r["p99"] for v in values)


def test_non_finite_values_are_left_out(spark):
    df = table(spark, [(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "x double")
    r = statistics.numeric_summary_linear(df, ["x"]).first()
    assert (r["n"], r["minimum"], r["median"], r["maximum"]) == (2, 1.0, 2.0, 3.0)


def test_repeated_quantiles_shrink_the_edges(spark):
    df = table(spark, [(5.0,)] * 50 + [(9.0,)], "x double")
    assert statistics.quantile_edges(df, ["x"]).first()["edges"] == [5.0]


# --- score tables ----------------------------------------------------------------------------


def brute(pairs):
    """Average precision, ROC-AUC and Brier score from their definitions."""
    p = sum(y for _, y in pairs)
    n = len(pairs) - p
    ap, seen = 0.0, 0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(y for s, y in pairs if s >= t)
        size = sum(1 for s, _ in pairs if s >= t)
        ap += (tp - seen) / p * tp / size
        seen = tp
    auc = sum(
        1.0 if a > b else 0.5 if a == b else 0.0
        for a, y in pairs if y for b, z in pairs if not z
    ) / (p * n)
    return ap, auc, sum((s - y) ** 2 for s, y in pairs) / len(pairs)


def random_pairs(seed, size, ties):
    rng = random.Random(seed)
    return [(rng.randint(0, ties) / ties, rng.random() < 0.3) for _ in range(size)]


@pytest.mark.parametrize("seed,ties,per_range", [(1, 7, 10**9), (2, 500, 20), (3, 10**6, 15)])
def test_metrics_equal_their_definitions(spark, seed, ties, per_range):
    pairs = random_pairs(seed, 220, ties)
    df = table(spark, [(s, y, 1) for s, y in pairs], "score double, flag boolean, fold int")
    r = scores.fold_metrics(df, rows_per_range=per_range).first()
    for got, want in zip((r["average_precision"], r["roc_auc"], r["brier_score"]), brute(pairs)):
        assert got == pytest.approx(want, abs=1e-12)
    moved = df.withColumn("score", F.pow("score", 3) / 2)
    m = scores.fold_metrics(moved, rows_per_range=per_range).first()
    assert m["average_precision"] == pytest.approx(r["average_precision"], abs=1e-12)
    assert m["roc_auc"] == pytest.approx(r["roc_auc"], abs=1e-12)


def best_by_fractions(pairs):
    p = sum(y for _, y in pairs)
    options = []
    for t in {s for s, _ in pairs}:
        tp = sum(y for s, y in pairs if s >= t)
        fp = sum(not y for s, y in pairs if s >= t)
        options.append((Fraction(2 * tp, p + tp + fp), tp, -t))
    top = max(options)
    return -top[2], sum(o[0] == top[0] for o in options), len(options)


@pytest.mark.parametrize("seed", range(4))
def test_best_threshold_equals_fraction_search(spark, seed):
    pairs = random_pairs(seed, 60, 8 if seed % 2 else 1000)
    df = table(spark, pairs, "score double, flag boolean")
    r = scores.best_f1_threshold(df, rows_per_range=7).first()
    assert (r["threshold"], r["candidates_at_maximum"], r["candidates"]) == best_by_fractions(pairs)


def test_equal_f1_goes_to_higher_recall(spark):
    # Threshold 0.9 gives TP 1 of 1; threshold 0.1 gives TP 2 of 4: F1 is 2/3 both times.
    pairs = [(0.9, True), (0.5, False), (0.4, False), (0.1, True)]
    r = scores.best_f1_threshold(table(spark, pairs, "score double, flag boolean")).first()
    assert (r["threshold"], r["candidates_at_maximum"], r["recall_decided"]) == (0.1, 2, True)


def test_equal_recall_goes_to_lower_threshold(spark):
    pairs = [(0.9, False), (0.5, False)]
    r = scores.best_f1_threshold(table(spark, pairs, "score double, flag boolean")).first()
    assert (r["threshold"], r["f1"], r["lower_score_decided"]) == (0.5, 0.0, True)


def test_repeated_scores_are_one_candidate(spark):
    pairs = [(0.9, True), (0.8, False), (0.8, True), (0.4, False), (0.2, True), (0.1, False)]
    assert scores.best_f1_threshold(table(spark, pairs, "score double, flag boolean")).first()["candidates"] == 5


def test_negative_zero_is_zero(spark):
    df = table(spark, [(0.0, True), (-0.0, False)], "score double, flag boolean")
    assert scores.score_cells(df).count() == 1


@pytest.mark.parametrize("per_range", [25, 10**9])
def test_calibration_equals_numpy(spark, per_range):
    pairs = random_pairs(11, 400, 90)
    df = table(spark, pairs, "score double, flag boolean")
    got = scores.calibration_table(df, rows_per_range=per_range).orderBy("bin").collect()
    s, y = np.array([p for p, _ in pairs]), np.array([f for _, f in pairs])
    edges = np.percentile(s, np.linspace(0, 100, 11))
    ids = np.searchsorted(edges[1:-1], s)
    used = np.unique(ids)
    assert [r["bin"] for r in got] == list(range(1, len(used) + 1))
    for r, i in zip(got, used):
        inside = ids == i
        assert r["rows"] == inside.sum()
        assert r["mean_score"] == pytest.approx(s[inside].mean())
        assert r["observed_rate"] == pytest.approx(y[inside].mean())
        assert (r["score_min"], r["score_max"]) == (s[inside].min(), s[inside].max())


def test_undefined_ratios_are_zero(spark):
    df = table(spark, [(0.1, False), (0.2, False)], "score double, flag boolean")
    cells = scores.score_cells(df)
    r = cells.agg(*[c.alias(n) for n, c in scores.confusion(0.9).items()]).first()
    assert (r["precision"], r["recall"], r["f1"], r["tn"]) == (0.0, 0.0, 0.0, 2)


# --- runs ------------------------------------------------------------------------------------

METRICS = "run string, fold int, rows long, average_precision double, roc_auc double, brier_score double"


def test_exact_tie_has_no_best_run(spark):
    board = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.4)], "run string, ap_mean double")
    with pytest.raises(Exception, match="no unique best run"):
        runs.select_best(board).collect()
    assert runs.select_best(board.where("run <> 'b'")).first()["run"] == "a"


def test_differing_folds_are_reported(spark, rows):
    m = spark.createDataFrame(
        [("a", 1, 10, 0.5, 0.6, 0.2), ("b", 1, 11, 0.4, 0.6, 0.2), ("a", 2, 5, 0.5, 0.6, 0.2)], METRICS
    )
    bad = runs.comparable_runs(m, ["rows"]).where("NOT agrees")
    assert rows(bad, "fold", "measure") == [(1, "rows"), (2, "runs")]


def test_population_deviation_and_last_fold(spark):
    m = spark.createDataFrame(
        [("a", 1, 10, 0.2, 0.6, 0.2), ("a", 3, 10, 0.6, 0.8, 0.4), ("a", 2, 10, 0.4, 0.7, 0.3)], METRICS
    )
    r = runs.run_summary(m).first()
    assert r["ap_deviation"] == pytest.approx(np.std([0.2, 0.4, 0.6])) and r["ap_last_fold"] == 0.6


# --- drift -----------------------------------------------------------------------------------


def drift_frame(spark, development, comparison):
    rows = [(2021, v) for v in development] + [(2025, v) for v in comparison]
    return spark.createDataFrame(rows, "period int, kind string")


@pytest.mark.parametrize(
    "development,comparison,distance", [("aab", "aab", 0.0), ("aa", "bb", 1.0), ("aabb", "abbb", 0.25), ("ab", "aabb", 0.0)]
)
def test_distance(spark, development, comparison, distance):
    df = drift_frame(spark, development, comparison)
    forward = drift.categorical_drift(df, ["kind"], [2021], [2025]).first()
    backward = drift.categorical_drift(df, ["kind"], [2025], [2021]).first()
    assert forward["tvd"] == backward["tvd"] == distance


def test_distance_of_nothing_is_zero(spark):
    cells = spark.createDataFrame([], "d long, c long")
    assert drift.total_variation_distance(cells, "d", "c").first()["tvd"] == 0.0


def test_new_and_missing_categories_and_null_label(spark, rows):
    df = drift_frame(spark, ["a", "b", "b"], ["a", None, "z", "z"])
    r = drift.categorical_drift(df, ["kind"], [2021], [2025]).first()
    assert (r["shared_categories"], r["new_categories"], r["missing_categories"], r["new_rows"]) == (1, 2, 1, 3)
    assert r["largest_change_category"] == "b"
    new = drift.new_categories(df, ["kind"], [2021], [2025])
    assert rows(new, "category", "comparison_rows", "first_period") == [("<NULL>", 1, 2025), ("z", 2, 2025)]


def test_largest_change_tie_goes_to_smaller_label(spark):
    r = drift.categorical_drift(drift_frame(spark, "ab", "cd"), ["kind"], [2021], [2025]).first()
    assert r["largest_change_category"] == "a"


@pytest.mark.parametrize("per_range", [10, 10**9])
def test_edges_come_from_development_and_extremes_fall_in_end_bins(spark, per_range):
    rows = [(2021, float(v)) for v in range(101)] + [(2025, -500.0), (2025, 900.0)]
    df = spark.createDataFrame(rows, "period int, x double")
    r = drift.numeric_drift(df, ["x"], [], [2021], [2025], rows_per_range=per_range).first()
    assert r["development_edges"] == "|".join(f"{v}.0" for v in range(10, 100, 10))
    assert r["development_bin_count"] == 10 and r["comparison_maximum"] == 900.0
    # Both extremes sit in the end bins, which hold 10 and 11 of the 101 development rows.
    assert r["distribution_tvd"] == pytest.approx(80 / 101, abs=1e-9)


def test_discrete_column_uses_exact_values(spark):
    rows = [(2021, 1.0), (2021, 2.0), (2025, 2.0), (2025, 3.0)]
    df = spark.createDataFrame(rows, "period int, x double")
    r = drift.numeric_drift(df, [], ["x"], [2021], [2025]).first()
    assert (r["audit_method"], r["distribution_tvd"], r["development_bin_count"]) == ("discrete_exact_tvd", 0.5, None)


def test_token_drift_counts_a_repeated_token_once(spark, rows):
    df = spark.createDataFrame(
        [(2021, "Reta;Reta;Curva"), (2021, "Reta"), (2025, "Ponte")], "period int, layout string"
    )
    got = drift.multilabel_drift(df, "layout", [2021], [2025])
    assert rows(got, "token", "development_rows", "difference_points", "presence") == [
        ("Curva", 1, -50.0, "missing"), ("Ponte", 0, 100.0, "new"), ("Reta", 2, -100.0, "missing"),
    ]


@pytest.mark.parametrize("per_range", [3, scores.ROWS_PER_RANGE])
@pytest.mark.parametrize("score,flag", [(None, True), (float("nan"), True), (1.5, False), (-0.1, True), (0.5, None)])
def test_bad_scores_and_flags_fail_at_any_size(spark, score, flag, per_range):
    pairs = [(i / 20, i % 3 == 0, True) for i in range(20)] + [(score, flag, True)]
    df = spark.createDataFrame(pairs, "score double, flag boolean, decision boolean").withColumn("period", F.lit(1))
    for made in (
        lambda: scores.best_f1_threshold(df, rows_per_range=per_range),
        lambda: scores.threshold_table(df, {"t": 0.5}).select("tp"),
        lambda: scores.outcome_profile(df, rows_per_range=per_range).select("share"),
    ):
        with pytest.raises(Exception, match="score is not in 0-1"):
            made().collect()


# --- quantiles by brackets -------------------------------------------------------------------

SHARES = {"lowest": 0.0, "p1": 0.01, "median": 0.5, "p90": 0.9, "highest": 1.0}


def values_of(kind, n, seed=5):
    rng = np.random.default_rng(seed)
    return {
        "continuous": rng.normal(size=n),
        "hot value": np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n)),
        "few values": rng.integers(0, 4, n).astype(float),
        "far apart": np.sign(rng.normal(size=n)) * 10.0 ** rng.integers(-300, 300, n),
        "two steps": np.repeat([1.0, 2.0], [n // 2, n - n // 2]),
    }[kind]


@pytest.mark.parametrize(
    "kind,accuracy,most_inside,grid",
    [("far apart", 10_000, 200_000, 256), ("continuous", 20, 5, 8), ("hot value", 20, 5, 8), ("few values", 50, 40, 4), ("two steps", 20, 5, 8)],
)
def test_bracketed_quantiles_equal_numpy(spark, kind, accuracy, most_inside, grid):
    values = values_of(kind, 1501)
    rows = [("a" if i % 3 else None, float(v), None if i % 2 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double, half double").repartition(4)
    for by in ([], ["g"]):
        found = quantiles.exact_quantiles(df, ["x", "half"], by, SHARES, ["p90"], "p90", accuracy=accuracy, most_inside=most_inside, grid=grid)
        got = found.collect()
        assert len(got) == 2 * (2 if by else 1)
        for r in got:
            at = 1 if r["variable"] == "x" else 2
            mine = np.sort([row[at] for row in rows if row[at] is not None and (not by or row[0] == r["g"])])
            for name, share in SHARES.items():
                want = mine[math.floor((len(mine) - 1) * share + 0.5)] if name == "p90" else np.percentile(mine, share * 100)
                assert r[name] == pytest.approx(want, rel=1e-12)
            assert (r["n"], r["minimum"], r["maximum"]) == (len(mine), mine[0], mine[-1])
            assert r["rows_above_p90"] == (mine > r["p90"]).sum()


def test_a_sketch_that_misses_is_mended(spark, monkeypatch):
    values = np.random.default_rng(3).normal(size=700)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")

    def wrong(*_):
        return spark.createDataFrame([("x", 700, [9.0] * 5, [10.0] * 5, 1)], "variable string, rows long, lows array<double>, highs array<double>, inside long")

    monkeypatch.setattr(quantiles, "_first_brackets", wrong)
    r = quantiles.exact_quantiles(df, ["x"], shares=SHARES).first()
    assert r["median"] == pytest.approx(np.median(values)) and r["p90"] == pytest.approx(np.percentile(values, 90))


def test_no_value_outside_the_brackets_is_kept(spark):
    n = 40_000
    df = spark.range(n).select((F.col("id") * 1.0).alias("x"))
    positions = quantiles.Positions({"median": 0.5, "p99": 0.99}, [])
    brackets = quantiles._first_brackets(df, ["x"], [], positions, 1000)
    cells = quantiles._cells(df, ["x"], [], brackets, 2)
    single = cells.where("least = most").count()
    assert 4 <= single <= 4 * n * 4 / 1000 and cells.agg(F.sum("n")).first()[0] == n
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan


def test_inexact_quantiles_are_within_the_sketch_error(spark):
    df = spark.range(50_000).select((F.col("id") * 1.0).alias("x"))
    r = statistics.numeric_summary_linear(df, ["x"], exact=False, accuracy=100).first()
    assert (r["n"], r["minimum"], r["maximum"]) == (50_000, 0.0, 49_999.0)
    for name, share in statistics.QUARTILES_AND_TAIL.items():
        assert abs(r[name] - share * 50_000) <= 501
    nothing = statistics.numeric_summary_linear(df.where("x < 0"), ["x"])
    assert nothing.count() == 0


@pytest.mark.parametrize("sides", [([2021], [2030]), ([2030], [2025])])
def test_an_empty_side_is_an_error(spark, sides):
    df = spark.createDataFrame([(2021, 1.0, "a"), (2025, 2.0, "b")], "period int, x double, kind string")
    with pytest.raises(ValueError, match="one side of the comparison is empty"):
        drift.numeric_drift(df, ["x"], [], *sides)
    with pytest.raises(Exception, match="one side of the comparison is empty"):
        drift.categorical_drift(df, ["kind"], *sides).collect()

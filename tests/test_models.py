from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ratescope.operators import explain, features, models, scores, splits
from ratescope.plans import splits as plan_splits
from ratescope.runtime import scratch_path

RECIPE = features.Recipe(("uf",), ("km",), ("night",))


@pytest.fixture(scope="module")
def df(spark):
    """Two years of rows where one state and high kilometres raise the flag; 2023 has a new state."""
    return spark.range(900).select(
        "id",
        (F.lit(2021) + F.floor(F.col("id") / 300).cast("int")).alias("period"),
        F.when((F.col("id") >= 600) & (F.col("id") % 10 == 0), "ZZ")
        .otherwise(F.element_at(F.array(F.lit("SC"), F.lit("PR"), F.lit("RS")), (F.col("id") % 3 + 1).cast("int")))
        .alias("uf"),
        ((F.col("id") * 37) % 101).cast("double").alias("km"),
        (F.col("id") % 2).cast("int").alias("night"),
        ((((F.col("id") * 37) % 101) > 60) | ((F.col("id") % 3 == 0) & (F.col("id") % 5 < 2))).alias("flag"),
    )


def test_folds_expand():
    folds = splits.expanding_folds([2023, 2021, 2022, 2024])
    assert [(f.fold, f.train, f.validation) for f in folds] == [
        (1, (2021,), 2022), (2, (2021, 2022), 2023), (3, (2021, 2022, 2023), 2024),
    ]
    assert splits.split_errors(folds, [2021, 2022, 2023, 2024], 2025) == []


@pytest.mark.parametrize(
    "fold,text",
    [
        (splits.Fold(1, (2022,), 2022), "not before"),
        (splits.Fold(1, (2023,), 2022), "not before"),
        (splits.Fold(1, (2021,), 2025), "final period"),
        (splits.Fold(1, (2019,), 2022), "outside development"),
        (splits.Fold(1, (), 2022), "not before"),
    ],
)
def test_broken_splits_are_named(fold, text):
    assert any(text in e for e in splits.split_errors([fold], [2021, 2022], 2025))


def test_ids_on_both_sides_are_counted(spark, rows):
    df = spark.createDataFrame([(1, 2021, True), (1, 2022, True), (2, 2022, None)], "id int, period int, flag boolean")
    got = dict(rows(splits.check_folds(df, splits.expanding_folds([2021, 2022]), [2021, 2022], 2023, "id")))
    assert got["fold_1_ids_in_both_sides"] == 1 and got["duplicated_ids"] == 2 and got["flag_null"] == 1


def test_leaking_column_is_refused():
    with pytest.raises(ValueError, match="forbidden"):
        features.Roles(("id",), "flag", ("dead",), ("dead",))
    with pytest.raises(ValueError, match="two roles"):
        features.Roles(("id",), "flag", ("id",))


def test_encoder_knows_training_only(df):
    train = df.where("period < 2023")
    model = features.fit_recipe(train, RECIPE)
    out = model.transform(df)
    names = [r["level"] for r in features.feature_map(out, RECIPE).orderBy("index").collect()]
    assert names == ["PR", "RS", "SC", "", ""]
    new = out.where("uf = 'ZZ'").select(vector_to_array("features").alias("v")).first()["v"]
    assert new[:3] == [0.0, 0.0, 0.0]
    km = [r["km"] for r in train.collect()]
    scaled = out.where("id = 7").select("km", vector_to_array("features").alias("v")).first()
    assert scaled["v"][3] == pytest.approx((scaled["km"] - np.mean(km)) / np.std(km))
    check = features.check_matrix(out, RECIPE).first()
    assert (check["expected_width"], check["wrong_width_rows"], check["non_finite_rows"]) == (5, 0, 0)


def test_constant_column_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "km double")
    assert [r["km_scaled"] for r in features.standardize(df, df, ["km"]).collect()] == [0.0, 0.0]


def test_unknown_rows_are_counted_once(spark, rows):
    df = spark.createDataFrame(
        [(2021, "a", "x"), (2022, "b", "y"), (2022, "b", "x"), (2022, "a", "x")], "period int, u string, w string"
    )
    folds = splits.expanding_folds([2021, 2022])
    cells = features.fold_cells(df, ["u", "w"], folds)
    assert rows(features.unknown_audit(cells), "feature", "rows_with_unknown") == [("u", 2), ("w", 1)]
    assert rows(features.rows_with_any_unknown(df, cells, ["u", "w"], folds)) == [(1, 2)]


FITS = {
    "logistic": models.fit_logistic,
    "forest": lambda t, r, f: models.fit_forest(t, r, f, trees=8, depth=5),
    "boosted": lambda t, r, f: models.fit_boosted(t, r, f, rounds=8, rate=0.3, depth=3),
}


@pytest.mark.parametrize("name", FITS)
def test_out_of_fold_ranks_better_than_chance(df, name):
    folds = splits.expanding_folds([2021, 2022, 2023])
    scored = models.out_of_fold(df, folds, RECIPE, FITS[name], ["id"])
    assert scored.count() == 600 and scored.select("id").distinct().count() == 600
    for r in scores.fold_metrics(scored).collect():
        assert r["average_precision"] > r["positive_rate"] and r["roc_auc"] > 0.6


def test_too_few_iterations_are_an_error(df):
    with pytest.raises(RuntimeError, match="no convergence"):
        models.fit_logistic(df, RECIPE, max_iter=1)


def test_logistic_matches_its_optimality_condition(df):
    """At the optimum the penalised gradient is zero: w = C · Σ (y − p) · x."""
    model = models.fit_logistic(df, RECIPE, tolerance=1e-10)
    weights = np.array(model.stages[-1].coefficients.toArray())
    data = models.score(model, df, ["id", "flag"]).join(
        model.transform(df).select("id", vector_to_array("features").alias("x")), "id"
    ).collect()
    x = np.array([r["x"] for r in data])
    residual = np.array([float(r["flag"]) - r["score"] for r in data])
    assert residual.sum() == pytest.approx(0, abs=1e-3)
    assert x.T @ residual == pytest.approx(weights, abs=1e-3)


def test_saved_model_scores_the_same(spark, df):
    path = scratch_path(spark, "model")
    model = models.refit_all_development(df, [2021, 2022], RECIPE, FITS["boosted"], path)
    a = {r["id"]: r["score"] for r in models.score(model, df.where("period = 2023"), ["id"]).collect()}
    held = models.score_holdout(path, df, 2023, 0.4, ["id"]).collect()
    assert {r["id"]: r["score"] for r in held} == a
    assert all(r["decision"] == (r["score"] >= 0.4) for r in held)


# --- contributions ---------------------------------------------------------------------------


def expected_value(table, node, x, known):
    """Tree output when only the known features are given: others follow the training shares."""
    row = table[node]
    if row["left"] < 0:
        return row["prediction"]
    left, right = table[row["left"]], table[row["right"]]
    if row["feature"] in known:
        value = x[row["feature"]]
        go = value <= row["split_values"][0] if row["categories"] < 0 else value in row["split_values"]
        return expected_value(table, row["left"] if go else row["right"], x, known)
    return sum(
        side["rows"] / row["rows"] * expected_value(table, side["id"], x, known) for side in (left, right)
    )


@pytest.mark.parametrize("group_nodes", [10**6, 1])
def test_contributions_are_shapley_values(spark, df, group_nodes):
    model = FITS["boosted"](df.where("period < 2023"), RECIPE, "flag")
    sample = df.where("period = 2023").limit(6)
    table = explain.tree_contributions(model, sample, ["id"], group_nodes=group_nodes)
    assert explain.contribution_errors(table).first()["maximum_error"] < 1e-9
    trees = {}
    for r in explain.tree_nodes(spark, model).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    vectors = {
        r["id"]: r["x"]
        for r in model.transform(sample).select("id", vector_to_array("features").alias("x")).collect()
    }
    width = 5
    for r in table.collect():
        x = vectors[r["id"]]
        for i in range(width):
            others = [j for j in range(width) if j != i]
            value = 0.0
            for size in range(width):
                weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                for s in itertools.combinations(others, size):
                    for t, w in enumerate(model.stages[-1].treeWeights):
                        value += 2 * w * weight * (
                            expected_value(trees[t], 0, x, {*s, i}) - expected_value(trees[t], 0, x, set(s))
                        )
            assert r["contributions"][i] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("d", [1, 2, 7, 20, 80])
def test_long_paths_equal_all_subsets(d):
    """One path against every subset of its features (to 20), and against the sum that all values must have."""
    rng = np.random.default_rng(d)
    shares = rng.random(d).round(2)
    shares[rng.random(d) < 0.2] = 1.0
    if d == 7:
        shares[3] = 0.0
    path = explain.Path(1.7, tuple(range(d)), ((),) * d, tuple(shares))
    passes = (rng.random((4, d)) < 0.6).astype(float)
    passes[0] = 1.0
    got = explain.path_values(path, passes)
    total = 1.7 * (passes.prod(axis=1) - shares.prod())
    assert got.sum(axis=1) == pytest.approx(total, abs=1e-9)
    if d > 20:
        return
    for row, outcome in zip(got, passes, strict=True):
        for i in range(d):
            products, sizes = np.ones(1), np.zeros(1, dtype=int)
            for j in range(d):
                if j != i:
                    products = np.concatenate([products * shares[j], products * outcome[j]])
                    sizes = np.concatenate([sizes, sizes + 1])
            weights = np.array([1 / (d * math.comb(d - 1, k)) for k in range(d)])
            want = 1.7 * (outcome[i] - shares[i]) * (weights[sizes] * products).sum()
            assert row[i] == pytest.approx(want, abs=1e-9)


def test_trees_are_grouped_by_nodes(spark):
    nodes = spark.createDataFrame([(t, k) for t, n in enumerate((3, 4, 9, 1, 1)) for k in range(n)], "tree int, id int")
    assert explain.tree_groups(nodes, 7) == [(0, 1), (2, 2), (3, 4)]
    assert explain.tree_groups(nodes, 100) == [(0, 4)]


def test_vectors_and_long_rows_have_the_same_means(spark, rows):
    explained = spark.createDataFrame([([0.5, -0.1], 1), ([-0.3, 0.3], 1), ([0.0, 2.0], 2)], "contributions array<double>, g int")
    a = explain.contribution_means(explained, ["g"]).collect()
    b = explain.contribution_means(explain.long_contributions(explained, ["g"]), ["g"]).collect()
    both = [sorted((r["g"], r["index"], r["n"], round(r["a"], 12), round(r["s"], 12)) for r in x) for x in (a, b)]
    assert both[0] == both[1] and len(both[0]) == 4
    plan = explain.contribution_means(explained, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("aggregate_metrics")
    assert explain.contribution_means(explained.where("g > 5")).count() == 0


def test_rankings_add_up(spark):
    explained = spark.createDataFrame(
        [([0.5, -0.1, 0.2], True, True), ([-0.3, 0.3, 0.0], False, True)],
        "contributions array<double>, flag boolean, decision boolean",
    )
    names = spark.createDataFrame(
        [(0, "a=1", "a", "categorical", "1"), (1, "a=2", "a", "categorical", "2"), (2, "b", "b", "binary", "")],
        "index int, feature string, predictor string, predictor_group string, level string",
    )
    first, second = explain.contribution_ranking(explained, names).orderBy("rank").collect()
    assert (first["predictor"], first["features"], second["predictor"]) == ("a", 2, "b")
    assert first["mean_abs"] == pytest.approx(0.6) and first["mean_signed"] == pytest.approx(0.2)
    assert first["share"] + second["share"] == pytest.approx(1.0)
    by = {(r["predictor"], r["outcome"]): r for r in explain.contribution_by_outcome(explained, names).collect()}
    assert by["a", "TP"]["mean_abs"] == pytest.approx(0.6) and by["b", "FP"]["rows"] == 1


def test_expanding_folds_follow_the_periods_found(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("year(l_shipdate) in (1995, 1996)")
    kind = source.schema["l_shipdate"].dataType
    earlier = F.when(F.year("l_shipdate") == 1995, F.add_months("l_shipdate", -12)).otherwise(F.col("l_shipdate").cast("date"))
    source.withColumn("l_shipdate", earlier.cast(kind)).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {tuple(r) for r in plan_splits.expanding_folds(spark, str(tmp_path)).collect()}
    assert found == {(1, "train", 1994), (1, "validation", 1996)}


def test_equal_rows_are_fitted_once_with_their_weight(spark, monkeypatch):
    data = [("a", float(k % 3), k % 2, k % 5 < 2) for k in range(300)] + [("b", 1.0, 0, True)] * 50
    df = spark.createDataFrame(data, "u string, x double, z int, flag boolean")
    recipe = features.Recipe(("u",), ("x",), ("z",))
    seen, fit = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    got = models.fit_logistic(df, recipe, tolerance=1e-9)
    plain = models.LogisticRegression(
        featuresCol="features", labelCol="y", regParam=1.0 / 350, standardization=False, maxIter=500, tol=1e-9
    )
    rows = features.fit_recipe(df, recipe).transform(df).withColumn("y", F.col("flag").cast("double"))
    want = fit(plain, rows)
    assert seen == [13]
    assert list(got.stages[-1].coefficients) == pytest.approx(list(want.coefficients), abs=1e-6)
    assert got.stages[-1].intercept == pytest.approx(want.intercept, abs=1e-6)


def test_forest_of_equal_rows_is_grown_on_different_ones(spark, monkeypatch):
    k = F.col("id")
    df = spark.range(40_000).select(
        F.when(k % 7 < 3, "a").when(k % 7 < 6, "b").otherwise("c").alias("u"),
        (k % 11).cast("double").alias("x"),
        (k % 2).cast("int").alias("z"),
        ((k % 11 > 6) != (F.pmod(F.xxhash64("id"), F.lit(5)) == 0)).alias("flag"),
    )
    df = df.union(spark.createDataFrame([("d", 3.0, 1, True)] * 3, df.schema))
    recipe = features.Recipe(("u",), ("x",), ("z",))
    settings = {"trees": 12, "depth": 4, "min_leaf": 30}
    plain = models.fit_forest(df, recipe, **settings)
    seen, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models, "MERGED_ROWS", 40_000)
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    got = models.fit_forest(df, recipe, **settings)
    different = df.distinct()
    assert seen == [different.count()] * 12
    nodes = explain.tree_nodes(spark, got).collect()
    roots = {r["tree"]: r["rows"] for r in nodes if r["id"] == 0}
    # a bootstrap of n rows draws n of them but for about sqrt(n), and another number per tree
    assert sorted(roots) == list(range(12)) and len(set(roots.values())) > 6
    assert all(abs(n - 40_003) < 5 * 200 for n in roots.values())
    assert min(r["rows"] for r in nodes) >= 30
    scored = [
        {tuple(r)[:3]: r["score"] for r in models.score(m, different, ["u", "x", "z"]).collect()} for m in (plain, got)
    ]
    assert scored[0].keys() == scored[1].keys()
    assert np.mean([abs(scored[0][key] - scored[1][key]) for key in scored[0]]) < 0.05
    again = models.fit_forest(df.repartition(3), recipe, **settings)
    scored = {tuple(r)[:3]: r["score"] for r in models.score(again, different, ["u", "x", "z"]).collect()}
    want = {tuple(r)[:3]: r["score"] for r in models.score(got, different, ["u", "x", "z"]).collect()}
    assert scored == pytest.approx(want) and again.stages[-1].treeWeights == [1.0] * 12

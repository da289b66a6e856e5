"""Boosted trees against a plain recursion over rows, and a case worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ratescope.operators import boosting
from ratescope.operators.boosting import Settings

ALL = dict(rows_share=1.0, columns_share=1.0)


def plain_tree(x, g, h, s, depth=0):
    """A tree as nested tuples, by trying every split of every feature on the rows themselves."""
    weight = -s.rate * g.sum() / (h.sum() + s.penalty)
    worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + s.penalty)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) < s.least_weight:
                continue
            gain = (worth(left) + worth(~left) - worth(np.ones(len(g), bool))) / 2
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut, left)
    if depth == s.depth or best is None or best[0] <= 1e-6:
        return weight
    _, f, cut, left = best
    return f, cut, plain_tree(x[left], g[left], h[left], s, depth + 1), plain_tree(x[~left], g[~left], h[~left], s, depth + 1)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_margins(x, y, s):
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, p - y, p * (1 - p), s)
        margin = margin + [plain_value(tree, row) for row in x]
    return margin


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y, strict=True)], ["features", "label"]).repartition(3)


def margins_of(model, df):
    out = model.transform(df).select(vector_to_array("features").alias("x"), vector_to_array("rawPrediction")[1].alias("m"), vector_to_array("probability")[1].alias("p"))
    rows = out.collect()
    for r in rows:
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-2 * r["m"])))
    return sorted((tuple(r["x"]), 2 * r["m"]) for r in rows)


def test_two_rounds_equal_a_plain_recursion(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 2, 300), rng.normal(size=300).round(1), rng.integers(-3, 4, 300)], axis=1).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0))))).astype(float)
    s = Settings(rounds=2, rate=0.3, depth=3, written_every=1, **ALL)
    df = frame(spark, x, y)
    model = boosting.SecondOrder("features", "label", s).fit(df)
    want = sorted((tuple(a), m) for a, m in zip(x.tolist(), plain_margins(x, y, s), strict=True))
    got = margins_of(model, df)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_a_case_by_hand(spark):
    # Four rows of 0 (one positive), four of 1 (three positive): margin 0, p = 1/2, every Hessian 1/4.
    # Left G = 4/2 - 1 = 1, H = 1; right G = -1, H = 1. The leaves weigh -1/(1+1) and 1/(1+1) times the rate.
    x, y = np.array([[0.0]] * 4 + [[1.0]] * 4), [1, 0, 0, 0, 1, 1, 1, 0]
    s = Settings(rounds=1, rate=0.1, depth=6, **ALL)
    got = margins_of(boosting.SecondOrder("features", "label", s).fit(frame(spark, x, y)), frame(spark, x, y))
    assert {k: pytest.approx(m) for k, m in got} == {(0.0,): -0.05, (1.0,): 0.05}
    # the second round starts from these margins
    p = 1 / (1 + np.exp(0.05))
    g, h = 4 * p - 1, 4 * p * (1 - p)
    two = margins_of(boosting.SecondOrder("features", "label", Settings(rounds=2, rate=0.1, depth=6, **ALL)).fit(frame(spark, x, y)), frame(spark, x, y))
    # with one Hessian too few on each side (h < 1) the second tree is a leaf of weight 0
    assert h < 1 and two[0][1] == pytest.approx(-0.05)
    light = Settings(rounds=2, rate=0.1, depth=6, least_weight=0.5, **ALL)
    two = margins_of(boosting.SecondOrder("features", "label", light).fit(frame(spark, x, y)), frame(spark, x, y))
    assert two[0][1] == pytest.approx(-0.05 - 0.1 * g / (h + 1))


def test_rows_and_columns_are_drawn_by_the_seed(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    df = frame(spark, x, y).cache()
    fits = [boosting.fit_trees(df, "features", "label", Settings(rounds=3, depth=2, seed=k, rows_share=0.5, columns_share=0.5))[1] for k in (1, 1, 2)]
    assert fits[0] == fits[1] != fits[2]
    for tree in fits[0]:
        assert 0.35 * 100 < tree.cover[0] / 0.25 * 0.5 < 0.65 * 400  # about half of the rows
        assert len({f for f in tree.feature if f >= 0}) <= 3


def test_many_values_are_binned_and_few_are_not(spark):
    rows = [(Vectors.dense([float(k % 2), float(k % 7), k / 1000.0]), float(k % 2)) for k in range(5000)]
    numbers = spark.createDataFrame(rows, ["features", "label"]).select(vector_to_array("features").alias("x"))
    two, seven, many = boosting.feature_cuts(numbers, 3, 64)
    assert two.tolist() == [0.5] and seven.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert 50 <= len(many) <= 63 and np.diff(many).max() < 3 * 5 / 64


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError, match="both classes"):
        boosting.SecondOrder("features", "label", Settings(rounds=1)).fit(frame(spark, np.zeros((3, 1)), [1, 1, 1]))


def test_weights_stand_for_equal_rows(spark):
    x = np.array([[k % 7, k % 3] for k in range(42)], dtype=float)
    y = np.array([int(k % 7 > 3 or k % 5 == 0) for k in range(42)])
    n = [1 + k % 4 for k in range(42)]
    each = frame(spark, np.repeat(x, n, axis=0), np.repeat(y, n))
    data = [(Vectors.dense(v), float(c), k) for v, c, k in zip(x, y, n, strict=True)]
    once = spark.createDataFrame(data, ["features", "label", "n"])
    s = Settings(rounds=3, rate=0.3, depth=3, rows_share=1.0, columns_share=1.0)
    a, b = boosting.fit_trees(each, "features", "label", s), boosting.fit_trees(once, "features", "label", s, "n", each)
    assert a[0] == pytest.approx(b[0])
    for p, q in zip(a[1], b[1], strict=True):
        assert (p.feature, p.code) == (q.feature, q.code)
        assert p.value == pytest.approx(q.value) and p.cover == pytest.approx(q.cover)

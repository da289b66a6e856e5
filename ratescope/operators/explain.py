"""Additive feature contributions of boosted trees and their rankings.

The contribution of a feature is its path-dependent Shapley value on the margin scale. Rows are
independent, so batches are handled in ``mapInPandas``; only the paths of a bounded group of trees travel
to the tasks at a time. Rankings add the rows' contributions up as vectors.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratescope.functions import outcome_label, stable_logistic
from ratescope.operators.ranking import numbered
from ratescope.runtime import scratch_path, settle

#: Nodes of the trees that are sent to the tasks together; a larger model takes several passes over the rows.
GROUP_NODES = 200_000


@dataclass(frozen=True)
class Path:
    """One leaf: margin value, distinct features, their tests, and the share of training rows that
    each feature's tests let through."""

    value: float
    features: tuple[int, ...]
    tests: tuple[tuple[tuple, ...], ...]
    shares: tuple[float, ...]


def tree_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(tree, id, prediction, rows, left, right, feature, split_values, categories) as saved."""
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["prediction"].alias("prediction"),
        node["rawCount"].alias("rows"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        node["split"]["leftCategoriesOrThreshold"].alias("split_values"),
        node["split"]["numCategories"].alias("categories"),
    )


def tree_groups(nodes: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of trees (first, last) with at most ``most`` nodes each; a larger tree is a group of its own."""
    groups, held = [], 0
    for row in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect():
        if groups and held + row["n"] <= most:
            groups[-1], held = (groups[-1][0], row["tree"]), held + row["n"]
        else:
            groups.append((row["tree"], row["tree"]))
            held = row["n"]
    return groups


def tree_paths(nodes: DataFrame, weights: Sequence[float], first: int, last: int) -> list[Path]:
    """All root-to-leaf paths of some trees. The margin of boosted trees is twice their weighted sum."""
    trees = defaultdict(dict)
    for row in nodes.where(F.col("tree").between(first, last)).collect():
        trees[row["tree"]][row["id"]] = row
    paths = []
    for tree, table in sorted(trees.items()):
        open_nodes = [(table[0], {})]
        while open_nodes:
            node, steps = open_nodes.pop()
            if node["left"] < 0:
                paths.append(
                    Path(
                        2.0 * weights[tree] * node["prediction"],
                        tuple(steps),
                        tuple(tuple(tests) for tests, _ in steps.values()),
                        tuple(share for _, share in steps.values()),
                    )
                )
                continue
            for side, goes_left in (("left", True), ("right", False)):
                child = table[node[side]]
                tests, share = steps.get(node["feature"], ((), 1.0))
                test = (goes_left, node["categories"], tuple(node["split_values"]))
                passed = share * (child["rows"] / node["rows"] if node["rows"] else 0.5)
                open_nodes.append((child, {**steps, node["feature"]: ((*tests, test), passed)}))
    return paths


def path_values(path: Path, passes: np.ndarray) -> np.ndarray:
    """Shapley values of one path for each pass/fail pattern (patterns × features).

    A subset S of the d − 1 other features weighs |S|!·(d−|S|−1)!/d!, which is the integral of t^|S|·(1−t)^(d−1−|S|)
    from 0 to 1. A feature in S contributes its outcome (0 or 1), one outside S its share, so the weighted sum over all subsets
    is the integral of the product of (share·(1−t) + outcome·t). That polynomial has degree d − 1, and the Gauss-Legendre rule with
    d/2 points integrates it without error. Products without one feature come from running products from both ends.
    All terms are positive: d² steps, no division, and no loss of digits on long paths.
    """
    d, shares = len(path.features), np.array(path.shares)
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    sums = np.zeros((len(passes), d))
    for t, weight in zip((points + 1) / 2, weights / 2, strict=True):
        factors = shares * (1 - t) + passes * t
        before, after = np.ones_like(factors), np.ones_like(factors)
        before[:, 1:] = np.cumprod(factors[:, :-1], axis=1)
        after[:, :-1] = np.cumprod(factors[:, :0:-1], axis=1)[:, ::-1]
        sums += weight * before * after
    return path.value * sums * (passes - shares)


def _passes(test: tuple, x: np.ndarray) -> np.ndarray:
    goes_left, categories, values = test
    left = x <= values[0] if categories < 0 else np.isin(x, values)
    return left if goes_left else ~left


def batch_contributions(paths: Sequence[Path], x: np.ndarray) -> np.ndarray:
    """Contributions of a batch (rows × features); each pattern of passed tests that occurs is worked out once."""
    out = np.zeros(x.shape)
    for path in paths:
        passes = np.stack(
            [np.logical_and.reduce([_passes(t, x[:, f]) for t in tests]) for f, tests in zip(path.features, path.tests, strict=True)],
            axis=1,
        )
        packed = np.ascontiguousarray(np.packbits(passes, axis=1))
        _, first, code = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        out[:, list(path.features)] += path_values(path, passes[first].astype(float))[code]
    return out


def tree_contributions(
    model: PipelineModel,
    df: DataFrame,
    keep: Sequence[str],
    features: str = "features",
    group_nodes: int = GROUP_NODES,
) -> DataFrame:
    """Kept columns, ``contributions`` (one number per feature), ``bias`` and the model's ``score``.

    bias + Σ contributions is the margin; ``contribution_errors`` checks it against the score. Trees are taken in
    groups of about ``group_nodes`` nodes; between groups the sums so far are written, so neither the driver nor a
    task holds more of a model than one group.
    """
    spark = df.sparkSession
    nodes, weights = tree_nodes(spark, model), model.stages[-1].treeWeights
    explained = model.transform(df).select(
        *keep,
        vector_to_array("probability")[1].alias("score"),
        vector_to_array(F.col(features)).alias("_x"),
        F.transform(vector_to_array(F.col(features)), lambda _: F.lit(0.0)).alias("contributions"),
    )
    schema, bias = explained.schema, 0.0
    groups = tree_groups(nodes, group_nodes)
    for number, (first, last) in enumerate(groups):
        paths = tree_paths(nodes, weights, first, last)
        bias += float(sum(p.value * np.prod(p.shares) for p in paths))
        explained = explained.mapInPandas(_adding([p for p in paths if p.features]), schema)
        explained = settle(explained) if number < len(groups) - 1 else explained
    return explained.select(*keep, "score", "contributions", F.lit(bias).alias("bias"))


def _adding(paths: Sequence[Path]):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, sums = np.stack(batch["_x"].to_numpy()), np.stack(batch["contributions"].to_numpy())
                yield batch.assign(contributions=list(sums + batch_contributions(paths, x)))

    return add


def contribution_errors(explained: DataFrame) -> DataFrame:
    """Largest and mean difference of the reconstructed probability from the model's score."""
    margin = F.col("bias") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    error = F.abs(stable_logistic(margin) - F.col("score"))
    return explained.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(error).alias("maximum_error"),
        F.avg(error).alias("mean_error"),
    )


def long_contributions(explained: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep…, index, contribution), one row per row and feature."""
    return explained.select(
        *keep, F.posexplode("contributions").alias("index", "contribution")
    )


def contribution_means(explained: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, index, n, a, s): rows, mean absolute and mean signed contribution per feature.

    Explained rows are added up as vectors, one per task and group, and only their sums become one row per feature. Rows in
    long form (``long_contributions``) are grouped instead.
    """
    if "contributions" not in explained.columns:
        return explained.groupBy(*by, "index").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs("contribution")).alias("a"), F.avg("contribution").alias("s")
        )
    summed = Summarizer.metrics("count", "mean", "normL1").summary(array_to_vector("contributions")).alias("_s")
    # grouping by a constant gives no row, and no sum of nothing, where there are no rows
    sums = explained.groupBy(*(by or [F.lit(0).alias("_all")])).agg(summed)
    both = F.arrays_zip(vector_to_array("_s.mean").alias("mean"), vector_to_array("_s.normL1").alias("total"))
    return sums.select(*by, F.col("_s.count").alias("n"), F.posexplode(both).alias("index", "_m")).select(
        *by, "index", "n", (F.col("_m.total") / F.col("n")).alias("a"), F.col("_m.mean").alias("s")
    )


def feature_ranking(explained: DataFrame, features: DataFrame) -> DataFrame:
    """Mean absolute and mean signed contribution per transformed feature, ranked."""
    means = contribution_means(explained).select("index", F.col("a").alias("mean_abs"), F.col("s").alias("mean_signed"))
    return numbered(means.join(features, "index"), "mean_abs", "feature").select(
        "rank", "feature", "predictor", "predictor_group", "level", "mean_abs", "mean_signed"
    )


def contribution_ranking(explained: DataFrame, features: DataFrame) -> DataFrame:
    """Per predictor: the sums over its features of the two means, share of the total, rank.

    A mean of sums is the sum of means, so rows never have to be put together again.
    """
    per_predictor = (
        contribution_means(explained)
        .join(features, "index")
        .groupBy("predictor", "predictor_group")
        .agg(
            F.count(F.lit(1)).alias("features"),
            F.sum("a").alias("mean_abs"),
            F.sum("s").alias("mean_signed"),
        )
    )
    # One row per predictor: the model bounds this table, so a plain window is enough.
    total = F.sum("mean_abs").over(Window.partitionBy())
    return numbered(per_predictor, "mean_abs", "predictor").withColumn(
        "share", F.col("mean_abs") / total
    )


def contribution_by_outcome(
    explained: DataFrame, features: DataFrame, flag: str = "flag", decision: str = "decision"
) -> DataFrame:
    """The same means per predictor within TP, FP, FN and TN."""
    means = contribution_means(explained.withColumn("outcome", outcome_label(flag, decision)), ["outcome"])
    return (
        means.join(features, "index")
        .groupBy("predictor", "outcome")
        .agg(
            F.max("n").alias("rows"),
            F.sum("a").alias("mean_abs"),
            F.sum("s").alias("mean_signed"),
        )
    )


def top_features(ranking: DataFrame, size: int = 15) -> DataFrame:
    return ranking.orderBy("rank").limit(size)


# Tasks get these helpers with the function itself, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

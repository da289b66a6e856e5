"""Spark ML classifiers over a recipe, out-of-fold scoring, refit and held-out scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.functions import at_least, demand
from ratescope.operators import boosting
from ratescope.operators.features import Recipe, recipe_stages
from ratescope.operators.splits import Fold
from ratescope.runtime import scratch_path, settle

LABEL = "_label"
WEIGHT = "_weight"
#: Rows from which a forest merges equal ones.
MERGED_ROWS = 100_000
#: Trees of a merged forest that grow at a time.
TREES_AT_A_TIME = 4
Fit = Callable[[DataFrame, Recipe, str], PipelineModel]


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _fit(train: DataFrame, recipe: Recipe, flag: str, estimator) -> PipelineModel:
    """Fit the recipe, then the estimator on the encoded rows.

    The estimator reads its rows once per iteration, so they are spread evenly before they are
    encoded: a few large input files would otherwise keep most cores idle through the whole fit.
    """
    encoder = Pipeline(stages=recipe_stages(train, recipe)).fit(train)
    narrow = train.select(*recipe.predictors, F.col(flag).cast("double").alias(LABEL))
    encoded = encoder.transform(narrow.repartition(_parts(train))).select(recipe.output, LABEL)
    return PipelineModel(stages=[*encoder.stages, estimator.fit(encoded)])


def weighted_rows(train: DataFrame, recipe: Recipe, flag: str) -> DataFrame:
    """(predictors…, label, weight): the different training rows and how often each occurs, settled."""
    keys = [*recipe.predictors, F.col(flag).cast("double").alias(LABEL)]
    return settle(train.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)))


def _fit_weighted(rows: DataFrame, recipe: Recipe, estimator) -> PipelineModel:
    """As ``_fit``, on different rows with their weights: the table itself was read once, to count them."""
    encoder = Pipeline(stages=recipe_stages(rows, recipe, WEIGHT)).fit(rows)
    encoded = encoder.transform(rows.repartition(_parts(rows))).select(recipe.output, LABEL, WEIGHT)
    return PipelineModel(stages=[*encoder.stages, estimator.fit(encoded)])


def fit_logistic(
    train: DataFrame,
    recipe: Recipe,
    flag: str = "flag",
    strength: float = 1.0,
    max_iter: int = 500,
    tolerance: float = 1e-4,
) -> PipelineModel:
    """L2 logistic regression with inverse regularisation ``strength``; not converging is an error.

    The usual objective ½‖w‖² + C·Σloss divided by C·n is Spark's with λ = 1/(C·n). Equal rows enter it once, with
    their number as weight: the sum is the same.
    """
    rows = weighted_rows(train, recipe, flag)
    total = rows.agg(F.sum(WEIGHT)).first()[0]
    estimator = LogisticRegression(
        featuresCol=recipe.output,
        labelCol=LABEL,
        weightCol=WEIGHT,
        elasticNetParam=0.0,
        regParam=1.0 / (strength * total),
        standardization=False,
        maxIter=max_iter,
        tol=tolerance,
    )
    model = _fit_weighted(rows, recipe, estimator)
    if model.stages[-1].summary.totalIterations >= max_iter:
        raise RuntimeError(f"no convergence in {max_iter} iterations")
    return model


def fit_forest(
    train: DataFrame,
    recipe: Recipe,
    flag: str = "flag",
    trees: int = 300,
    depth: int = 20,
    min_leaf: int = 5,
    seed: int = 42,
) -> PipelineModel:
    """Spark's random forest on bootstrapped rows.

    Of a table of many rows, equal ones become one row with a weight per tree: how often this tree's bootstrap draws
    the rows it stands for, which for n rows is a Poisson number of mean n. Each tree is then Spark's own on the different
    rows with these weights, ``min_leaf`` counts drawn rows as ever, and the table is read once. A table
    of few rows, or in which most rows differ, is left to Spark's forest, which draws every row by itself.
    """
    estimator = RandomForestClassifier(
        featuresCol=recipe.output,
        labelCol=LABEL,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        maxBins=256,
        maxMemoryInMB=1024,
        seed=seed,
    )
    rows = weighted_rows(train, recipe, flag)
    different, total = rows.agg(F.count(F.lit(1)), F.sum(WEIGHT)).first()
    if not total or total < max(MERGED_ROWS, 4 * different, 4 * min_leaf):
        return _fit(train, recipe, flag, estimator)
    encoder = Pipeline(stages=recipe_stages(rows, recipe, WEIGHT)).fit(rows)
    drawn = [f"_drawn{t}" for t in range(trees)]
    encoded = settle(encoder.transform(_bootstrapped(rows, drawn, seed)).select(recipe.output, LABEL, *drawn))
    totals, path = encoded.agg(*[F.sum(c) for c in drawn]).first(), scratch_path(train.sparkSession, "forest")

    def grow(t: int) -> None:
        # half a row less, so that the product of share and total is not above min_leaf by rounding
        own = {"weightCol": drawn[t], "seed": seed + t, "minWeightFractionPerNode": (min_leaf - 0.5) / totals[t]}
        tree = estimator.copy().setParams(numTrees=1, bootstrap=False, minInstancesPerNode=1, **own)
        tree.fit(encoded.select(recipe.output, LABEL, drawn[t])).write().save(f"{path}/tree-{t}")

    with ThreadPool(min(TREES_AT_A_TIME, trees)) as pool:
        pool.map(inheritable_thread_target(train.sparkSession)(grow), range(trees), chunksize=1)
    return PipelineModel(stages=[*encoder.stages, _forest_of(train.sparkSession, path, trees)])


def _bootstrapped(rows: DataFrame, drawn: list[str], seed: int) -> DataFrame:
    """``rows`` with columns ``drawn``: how often each tree draws one of the equal rows that a row stands for.

    The numbers follow from the seed and the row itself, so they are the same however the rows are dealt.
    """
    columns = rows.columns

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, weights = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_name", WEIGHT))
            counts = np.empty((len(drawn), len(names)), dtype=np.int64)
            for k, (name, weight) in enumerate(zip(names.view(np.uint64), weights, strict=True)):
                counts[:, k] = np.random.Generator(np.random.Philox(key=np.array([seed, name], dtype=np.uint64))).poisson(weight, len(drawn))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, counts)], names=[*columns, *drawn])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in drawn]])
    name = F.xxhash64(*[c for c in columns if c != WEIGHT])
    return rows.withColumn("_name", name).mapInArrow(draw, schema)


def _forest_of(spark: SparkSession, path: str, trees: int) -> RandomForestClassificationModel:
    """One model of the saved models tree-0, tree-1 … of one tree each, by Spark's saved form.

    A node's rows are those drawn, as in a forest on all rows, not the different ones among them.
    """
    number = F.regexp_extract("_metadata.file_path", r".*/tree-(\d+)/", 1).cast("int")
    counted = F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, x: a + x).cast("long")
    nodes = spark.read.parquet(f"{path}/tree-*/data")
    nodes.select(number.alias("treeID"), F.col("nodeData").withField("rawCount", counted).alias("nodeData")).write.parquet(f"{path}/whole/data")
    about = spark.read.parquet(f"{path}/tree-*/treesMetadata")
    about.withColumn(about.columns[0], number).coalesce(1).write.parquet(f"{path}/whole/treesMetadata")
    metadata = json.loads(spark.read.text(f"{path}/tree-0/metadata").first()[0])
    metadata["paramMap"] |= {"numTrees": trees}
    metadata |= {"numTrees": trees}
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/whole/metadata")
    return RandomForestClassificationModel.load(f"{path}/whole")


def fit_boosted(
    train: DataFrame,
    recipe: Recipe,
    flag: str = "flag",
    rounds: int = 300,
    rate: float = 0.05,
    depth: int = 6,
    rows_share: float = 0.8,
    columns_share: float = 0.8,
    seed: int = 42,
    estimator=None,
) -> PipelineModel:
    """Gradient boosted trees with second-order leaf weights (see ``boosting``).

    ``estimator`` replaces them by a Spark ML estimator, such as ``GBTClassifier``.
    """
    if estimator is None:
        settings = boosting.Settings(rounds, rate, depth, rows_share, columns_share, seed=seed)
        rows = weighted_rows(train, recipe, flag)
        encoder = Pipeline(stages=recipe_stages(rows, recipe, WEIGHT)).fit(rows)
        encoded = encoder.transform(rows.repartition(_parts(rows))).select(recipe.output, LABEL, WEIGHT)
        trees = boosting.SecondOrder(recipe.output, LABEL, settings, WEIGHT).fit(encoded, encoder.transform(train))
        return PipelineModel(stages=[*encoder.stages, trees])
    estimator = estimator.copy().setFeaturesCol(recipe.output).setLabelCol(LABEL)
    return _fit(train, recipe, flag, estimator)


def forest_statistics(model: PipelineModel) -> dict[str, float]:
    trees = model.stages[-1].trees
    depths, nodes = [t.depth for t in trees], [t.numNodes for t in trees]
    return {
        "trees": len(trees),
        "max_depth": max(depths),
        "mean_depth": sum(depths) / len(depths),
        "total_nodes": sum(nodes),
    }


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    """Kept columns plus the probability of the positive class; one outside 0–1 fails the query."""
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(df).select(*keep, p.alias(name))
    # a filter, so that the check holds where the score itself is not read
    return scored.where(demand(F.col(name).between(0.0, 1.0), "probability out of range"))


def out_of_fold(
    df: DataFrame,
    folds: Sequence[Fold],
    recipe: Recipe,
    fit: Fit,
    keep: Sequence[str],
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """Fit on each fold's training periods, score its validation period, stack the results.

    The few fits run one after another; each is a distributed job of its own. What they read is derived
    from the table once and written.
    """
    parts, columns = [], dict.fromkeys([*keep, period, flag, *recipe.predictors])
    df = settle(df.where(F.col(period).isin(*{p for f in folds for p in (*f.train, f.validation)})).select(*columns))
    for f in folds:
        model = fit(df.where(F.col(period).isin(*f.train)), recipe, flag)
        scored = score(model, df.where(F.col(period) == f.validation), [*keep, period, flag])
        parts.append(scored.withColumn("fold", F.lit(f.fold)))
    return reduce(DataFrame.unionByName, parts)


def refit_all_development(
    df: DataFrame,
    development: Sequence[int],
    recipe: Recipe,
    fit: Fit,
    path: str,
    flag: str = "flag",
    period: str = "period",
) -> PipelineModel:
    """Fit on all development periods, save, and return what was loaded back."""
    fit(df.where(F.col(period).isin(*development)), recipe, flag).write().save(path)
    return PipelineModel.load(path)


def score_holdout(
    path: str,
    df: DataFrame,
    final: int,
    threshold: float,
    keep: Sequence[str],
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """Score the final period with a saved model and attach the decision at a frozen threshold."""
    model = PipelineModel.load(path)
    scored = score(model, df.where(F.col(period) == final), [*keep, period, flag])
    return scored.withColumn("decision", at_least("score", threshold))

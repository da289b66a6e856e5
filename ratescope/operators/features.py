"""The model-ready table and train-only preprocessing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.functions import category_label, percent
from ratescope.operators.drift import long_values
from ratescope.operators.joins import alignment_report
from ratescope.operators.quality import check_rules, predictor_rules
from ratescope.operators.splits import Fold, fold_periods
from ratescope.operators.tokens import token_indicators
from ratescope.runtime import settle


@dataclass(frozen=True)
class Roles:
    """Which columns identify a row, which is the flag, which may predict and which must not."""

    metadata: tuple[str, ...]
    flag: str
    predictors: tuple[str, ...]
    forbidden: tuple[str, ...] = ()

    def __post_init__(self):
        leaked = set(self.forbidden) & {*self.metadata, self.flag, *self.predictors}
        if leaked:
            raise ValueError(f"forbidden columns have a role: {sorted(leaked)}")
        if len({*self.metadata, self.flag, *self.predictors}) != len(self.columns):
            raise ValueError("a column has two roles")

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.metadata, self.flag, *self.predictors)

    def table(self, df: DataFrame) -> DataFrame:
        """(column, role, type, in_model) of the model-ready table."""
        role = {c: "metadata" for c in self.metadata} | {self.flag: "flag"}
        rows = [
            (c, role.get(c, "predictor"), df.schema[c].dataType.simpleString(), c not in role)
            for c in self.columns
        ]
        return df.sparkSession.createDataFrame(
            rows, "column string, role string, type string, in_model boolean"
        )


def project_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Exactly the columns that have a role, in role order."""
    return df.select(*roles.columns)


def model_table(
    df: DataFrame,
    roles: Roles,
    derived: Mapping[str, Column] | None = None,
    token_field: str | None = None,
    token_columns: Mapping[str, str] | None = None,
    delimiter: str = ";",
) -> DataFrame:
    """Derived columns, one indicator per token and the role projection; a single narrow pass."""
    out = df.withColumns(dict(derived or {}))
    if token_field is not None:
        out = token_indicators(out, token_field, token_columns or {}, delimiter)
    return project_roles(out, roles)


def check_model_table(
    table: DataFrame,
    source: DataFrame,
    key_id: str,
    unchanged: Sequence[str],
    roles: Roles,
    binary: Sequence[str] = (),
) -> DataFrame:
    """(check, violations): schema, ids and unchanged columns against the source, predictor rules."""
    report = alignment_report(table, source, [key_id], unchanged)
    checks = ["missing_from_right", "missing_from_left", *[f"{c}_mismatches" for c in unchanged]]
    rows = F.array(
        F.struct(
            F.lit("column_order").alias("check"),
            F.lit(int(tuple(table.columns) != roles.columns)).cast("bigint").alias("violations"),
        ),
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in checks],
    )
    rules = check_rules(table, predictor_rules(table, roles.predictors, binary)).select(
        F.concat_ws(" ", "column", "rule").alias("check"), "violations"
    )
    return report.select(F.inline(rows)).unionByName(rules)


# --- preprocessing ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Recipe:
    """Column groups of the feature vector, in vector order."""

    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    output: str = field(default="features")

    @property
    def predictors(self) -> tuple[str, ...]:
        return (*self.categorical, *self.numeric, *self.binary)


def scaling(train: DataFrame, numeric: Sequence[str], weight: str | None = None) -> DataFrame:
    """(column, mean, deviation) over the training rows, with the population deviation.

    ``weight`` is the column that says how many rows one stands for.
    """
    if weight:
        n = {c: F.when(F.col(c).isNotNull(), F.col(weight)) for c in numeric}
        means = train.agg(F.struct(*[(F.sum(F.col(c) * n[c]) / F.sum(n[c])).alias(c) for c in numeric])).scalar()
        gaps = train.withColumns({f"d_{c}": F.pow(F.col(c) - means[c], 2) * n[c] for c in numeric})
        flat = gaps.agg(
            *[(F.sum(F.col(c) * n[c]) / F.sum(n[c])).cast("double").alias(f"m_{c}") for c in numeric],
            *[F.sqrt(F.sum(f"d_{c}") / F.sum(n[c])).alias(f"s_{c}") for c in numeric],
        )
    else:
        flat = train.agg(
            *[F.avg(c).alias(f"m_{c}") for c in numeric],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
        )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m_{c}").alias("mean"),
                F.col(f"s_{c}").alias("deviation"),
            )
            for c in numeric
        ]
    )
    return flat.select(F.inline(rows))


def standardize(df: DataFrame, train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_scaled``; mean and deviation come from ``train`` as one subquery."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in numeric],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
        )
    ).scalar()
    return df.withColumns(
        {
            f"{c}_scaled": (F.col(c) - stats[f"m_{c}"])
            / F.when(stats[f"s_{c}"] == 0, 1.0).otherwise(stats[f"s_{c}"])
            for c in numeric
        }
    )


def _scaler(train: DataFrame, numeric: Sequence[str], weight: str | None = None) -> SQLTransformer:
    """The scaling as a pipeline stage; the fitted numbers are part of its statement, so the stage
    is saved and loaded with the pipeline."""
    terms = ["*"]
    for row in scaling(train, numeric, weight).collect():
        deviation = row["deviation"] or 1.0
        terms.append(
            f"(CAST(`{row['column']}` AS DOUBLE) - CAST('{row['mean']!r}' AS DOUBLE))"
            f" / CAST('{deviation!r}' AS DOUBLE) AS `{row['column']}_scaled`"
        )
    return SQLTransformer(statement=f"SELECT {', '.join(terms)} FROM __THIS__")


def recipe_stages(train: DataFrame, recipe: Recipe, weight: str | None = None) -> list:
    """Stages that one-hot encode, scale and assemble, to be fitted on ``train`` only.

    ``handleInvalid='keep'`` gives unknown categories the last index and ``dropLast`` drops exactly
    that slot, so a category unseen in training becomes an all-zero block.
    """
    indexed = [f"{c}_index" for c in recipe.categorical]
    encoded = [f"{c}_onehot" for c in recipe.categorical]
    scaled = [f"{c}_scaled" for c in recipe.numeric]
    stages = []
    if recipe.categorical:
        stages += [
            StringIndexer(
                inputCols=list(recipe.categorical),
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
    if recipe.numeric:
        stages.append(_scaler(train, recipe.numeric, weight))
    stages.append(
        VectorAssembler(inputCols=[*encoded, *scaled, *recipe.binary], outputCol=recipe.output)
    )
    return stages


def fit_recipe(train: DataFrame, recipe: Recipe) -> PipelineModel:
    return Pipeline(stages=recipe_stages(train, recipe)).fit(train)


def feature_map(df: DataFrame, recipe: Recipe) -> DataFrame:
    """(index, feature, predictor, predictor_group, level) read from the vector's own attributes."""
    attributes = df.schema[recipe.output].metadata["ml_attr"]["attrs"]
    names = sorted((a["idx"], a["name"]) for group in attributes.values() for a in group)
    rows = []
    for index, name in names:
        for c in recipe.categorical:
            if name.startswith(f"{c}_onehot_"):
                rows.append((index, name, c, "categorical", name[len(f"{c}_onehot_") :]))
                break
        else:
            group = "binary" if name in recipe.binary else "numeric"
            predictor = name if group == "binary" else name.removesuffix("_scaled")
            rows.append((index, name, predictor, group, ""))
    return df.sparkSession.createDataFrame(
        rows,
        "index int, feature string, predictor string, predictor_group string, level string",
    )


def check_matrix(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Rows, vector width against the attribute list, and rows with a non-finite entry."""
    expected = df.schema[recipe.output].metadata["ml_attr"]["num_attrs"]
    v = vector_to_array(F.col(recipe.output))
    infinite = F.lit(float("inf"))
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == infinite))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(expected).alias("expected_width"),
        F.count_if(F.size(v) != expected).alias("wrong_width_rows"),
        F.count_if(bad).alias("non_finite_rows"),
    )


# --- categories unseen in training -----------------------------------------------------------

#: Values with a larger share of a fold's validation rows are looked up without a shuffle; a feature has fewer than 1 / FREQUENT of them.
FREQUENT = 0.005


def combination_counts(df: DataFrame, features: Sequence[str], period: str = "period") -> DataFrame:
    """(period, features…, n): rows per combination of values, settled.

    Everything that folds ask about categories follows from it, so the table itself is read once for all of them.
    """
    return settle(df.groupBy(period, *features).agg(F.count(F.lit(1)).alias("n")))


def fold_cells(
    df: DataFrame,
    features: Sequence[str],
    folds: Sequence[Fold],
    period: str = "period",
    weight: str | None = None,
) -> DataFrame:
    """(fold, feature, value, train, validation) from one grouping of the table, or of its combinations,
    whose ``weight`` column says how many rows they stand for.

    The grouping keeps one row per value with its rows in each period; the folds are sums of these. A join by period
    would bring everything to as many tasks as there are periods.
    """
    used = sorted({p for f in folds for p in (*f.train, f.validation)})
    n = F.col(weight) if weight else F.lit(1)
    sums = [F.coalesce(F.sum(F.when(F.col(period) == p, n)), F.lit(0)).alias(f"_{k}") for k, p in enumerate(used)]
    per_value = (
        long_values(df.where(F.col(period).isin(*used)), features, [period, *([weight] if weight else [])])
        .groupBy(F.col("variable").alias("feature"), category_label("value").alias("value"))
        .agg(*sums)
    )

    def side(periods):
        return reduce(Column.__add__, [F.col(f"_{used.index(p)}") for p in sorted(set(periods))], F.lit(0).cast("long"))

    sides = [
        F.struct(F.lit(f.fold).alias("fold"), side(f.train).alias("train"), side([f.validation]).alias("validation"))
        for f in folds
    ]
    return (
        per_value.select("feature", "value", F.inline(F.array(*sides)))
        .where("train > 0 OR validation > 0")
        .select("fold", "feature", "value", "train", "validation")
    )


def _unseen() -> Column:
    return (F.col("train") == 0) & (F.col("validation") > 0)


def unknown_audit(cells: DataFrame) -> DataFrame:
    """Per fold and feature: categories on both sides and validation rows with an unseen one."""
    rows = F.coalesce(F.sum(F.when(_unseen(), F.col("validation"))), F.lit(0))
    return cells.groupBy("fold", "feature").agg(
        F.count_if(F.col("train") > 0).alias("train_categories"),
        F.count_if(F.col("validation") > 0).alias("validation_categories"),
        F.count_if(_unseen()).alias("unknown_categories"),
        rows.alias("rows_with_unknown"),
        percent(rows, F.sum("validation")).alias("unknown_share_percent"),
    )


def unknown_values(cells: DataFrame) -> DataFrame:
    """The unseen categories themselves, one row each."""
    return cells.where(_unseen()).select(
        "fold", "feature", "value", F.col("validation").alias("rows")
    )


def rows_with_any_unknown(
    df: DataFrame,
    cells: DataFrame,
    features: Sequence[str],
    folds: Sequence[Fold],
    period: str = "period",
    weight: str | None = None,
) -> DataFrame:
    """Per fold: validation rows with at least one unseen category, each row counted once.

    The different combinations of values are looked up, not the rows: each as one entry per feature. ``df`` may be the
    combinations already, with their ``weight``. The few values with more than ``FREQUENT`` of a fold's rows are looked up
    in a broadcast list, so the entries that are dealt by value for the join with the unseen ones have no large group.
    """
    combinations = df if weight else df.groupBy(period, *features).agg(F.count(F.lit(1)).alias("n"))
    validated = fold_periods(df.sparkSession, folds, period).where("side = 'validation'")
    marked = combinations.join(F.broadcast(validated.select("fold", period)), period)
    key = ["fold", "feature", "label"]
    labels = cells.where("validation > 0").withColumnRenamed("value", "label")
    # every row has one value of each feature, so the counts of a feature add up to the rows of its fold
    totals = labels.groupBy("fold", "feature").agg(F.sum("validation").alias("_rows"))
    counted = labels.join(F.broadcast(totals), ["fold", "feature"])
    frequent = counted.where(F.col("validation") > F.col("_rows") * FREQUENT).select(*key, _unseen().alias("_new"))
    rare = counted.where(_unseen() & (F.col("validation") <= F.col("_rows") * FREQUENT)).select(*key)
    pairs = [F.struct(F.lit(c).alias("feature"), category_label(c).alias("label")) for c in features]
    entries = marked.select("fold", F.struct(*features).alias("_combination"), F.col(weight or "n").alias("n"), F.inline(F.array(*pairs))).join(
        F.broadcast(frequent), key, "left"
    )
    found = entries.where("_new").select("fold", "_combination", "n")
    looked_up = entries.where("_new IS NULL").join(rare, key, "left_semi").select("fold", "_combination", "n")
    hits = found.unionByName(looked_up).distinct().groupBy("fold").agg(F.sum("n").alias("_hit"))
    return (
        marked.select("fold")
        .distinct()
        .join(hits, "fold", "left")
        .select("fold", F.coalesce("_hit", F.lit(0)).cast("long").alias("rows_with_any_unknown"))
    )


def fold_preprocessing_summary(
    df: DataFrame, recipe: Recipe, folds: Sequence[Fold], period: str = "period"
) -> DataFrame:
    """One row per fold: sizes, output width by group, and unseen-category counts.

    All of it follows from the counts of the value combinations, so the table is read once.
    """
    counts = combination_counts(df, recipe.categorical, period)
    cells = settle(fold_cells(counts, recipe.categorical, folds, period, "n"))
    per_fold = unknown_audit(cells).groupBy("fold").agg(
        F.sum("train_categories").alias("categorical_outputs"),
        F.sum("rows_with_unknown").alias("unknown_occurrences"),
    )

    def rows(name):
        return F.sum(F.when(F.col("side") == name, F.col("n"))).alias(f"{name}_rows")

    sizes = (
        counts.groupBy(period)
        .agg(F.sum("n").alias("n"))
        .join(fold_periods(df.sparkSession, folds, period), period)
        .groupBy("fold")
        .agg(rows("train"), rows("validation"))
    )
    return (
        sizes.join(per_fold, "fold")
        .join(rows_with_any_unknown(counts, cells, recipe.categorical, folds, period, "n"), "fold")
        .select(
            "fold",
            "train_rows",
            "validation_rows",
            F.lit(len(recipe.predictors)).alias("input_predictors"),
            (F.col("categorical_outputs") + len(recipe.numeric) + len(recipe.binary)).alias(
                "output_features"
            ),
            "categorical_outputs",
            F.lit(len(recipe.numeric)).alias("numeric_outputs"),
            F.lit(len(recipe.binary)).alias("binary_outputs"),
            "unknown_occurrences",
            "rows_with_any_unknown",
        )
    )

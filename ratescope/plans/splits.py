"""Model-ready table, expanding folds, train-only preprocessing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope.operators import features, splits
from ratescope.plans.registry import query
from ratescope.plans.rates import LATE, late_kinds
from ratescope.plans.tables import DEVELOPMENT, FINAL, FLAGGED, ITEMS, NAME_TOKENS, OCC, ORD
from ratescope.plans.tables import items, occurrences, orders

FOLDS = splits.expanding_folds(DEVELOPMENT)
FOLD_SQL = "f AS (" + " UNION ALL ".join(
    f"SELECT {f.fold} AS fold, '{side}' AS side, {p} AS period"
    for f in FOLDS
    for side, p in [*(("train", p) for p in f.train), ("validation", f.validation)]
) + ")"


@query("expanding_folds", f"WITH {OCC}, {FOLD_SQL} SELECT * FROM f WHERE period IN (SELECT period FROM occ)")
def expanding_folds(spark, folder):
    """Folds that follow from the periods of the table."""
    periods = occurrences(spark, folder).where(F.col("period") < FINAL).select("period").distinct()
    folds = splits.expanding_folds([r["period"] for r in periods.collect()])
    return splits.fold_periods(spark, folds).select("fold", "side", "period")


@query(
    "check_folds",
    f"""WITH {OCC}, ids AS (SELECT l_orderkey, count(*) AS n, list(DISTINCT period) AS p FROM occ GROUP BY 1)
SELECT 'duplicated_ids' AS "check", CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS violations FROM ids
UNION ALL SELECT 'flag_null', 0 FROM (SELECT 1) UNION ALL SELECT 'rows_outside_partitions', 0 FROM (SELECT 1)
UNION ALL SELECT 'ids_in_development_and_final', count(*) FROM ids WHERE list_contains(p, 2001) AND len(p) > 1
UNION ALL SELECT 'split_errors', 0 FROM (SELECT 1) """
    + " ".join(
        f"UNION ALL SELECT 'fold_{f.fold}_ids_in_both_sides', count(*) FROM ids"
        f" WHERE list_has_any(p, {list(f.train)}) AND list_contains(p, {f.validation})"
        for f in FOLDS
    ),
)
def check_folds(spark, folder):
    """Order keys are not unique among line items, so overlaps are found."""
    return splits.check_folds(
        occurrences(spark, folder), FOLDS, DEVELOPMENT, FINAL, "l_orderkey"
    )


PARTS = "parts AS (" + " UNION ALL ".join(
    [f"SELECT 'period_{p}' AS partition_id, 'annual' AS partition_role, {p} AS period" for p in (*DEVELOPMENT, FINAL)]
    + [f"SELECT 'development', 'development', {p}" for p in DEVELOPMENT]
    + [f"SELECT 'final', 'final_evaluation', {FINAL}"]
    + [f"SELECT 'fold_{f.fold}_train', 'fold_train', {p}" for f in FOLDS for p in f.train]
    + [f"SELECT 'fold_{f.fold}_validation', 'fold_validation', {f.validation}" for f in FOLDS]
) + ")"


@query(
    "partition_summary",
    f"""WITH {OCC}, {PARTS} SELECT partition_id, partition_role,
  string_agg(DISTINCT CAST(period AS VARCHAR), ',' ORDER BY CAST(period AS VARCHAR)) AS periods,
  count(*) AS total, {FLAGGED} AS flagged, count(*) FILTER (WHERE NOT flag) AS unflagged,
  round({FLAGGED} / count(*) * 100, 6) AS rate_percent FROM occ JOIN parts USING (period) GROUP BY ALL""",
)
def partition_summary(spark, folder):
    return splits.partition_summary(occurrences(spark, folder), FOLDS, DEVELOPMENT, FINAL)


@query(
    "fold_table",
    f"""WITH {OCC}, {FOLD_SQL}, x AS (SELECT occ.flag, f.* FROM occ JOIN f USING (period))
SELECT CAST(fold AS INTEGER) AS fold,
  string_agg(DISTINCT CAST(period AS VARCHAR), ',' ORDER BY CAST(period AS VARCHAR)) FILTER (WHERE side = 'train') AS train_periods,
  CAST(max(period) FILTER (WHERE side = 'validation') AS INTEGER) AS validation_period,
  count(*) FILTER (WHERE side = 'train') AS train_rows, count(*) FILTER (WHERE side = 'validation') AS validation_rows,
  count(*) FILTER (WHERE side = 'train' AND flag) AS train_flagged,
  count(*) FILTER (WHERE side = 'validation' AND flag) AS validation_flagged,
  round(count(*) FILTER (WHERE side = 'train' AND flag) / count(*) FILTER (WHERE side = 'train') * 100, 6) AS train_rate_percent,
  round(count(*) FILTER (WHERE side = 'validation' AND flag) / count(*) FILTER (WHERE side = 'validation') * 100, 6) AS validation_rate_percent
FROM x GROUP BY fold""",
)
def fold_table(spark, folder):
    return splits.fold_table(occurrences(spark, folder), FOLDS)


# --- model-ready table -----------------------------------------------------------------------

ROLES = features.Roles(
    ("l_orderkey", "period"),
    "flag",
    ("month_name", "l_returnflag", "code", "l_quantity", *[f"has_{t}" for t in NAME_TOKENS]),
    ("l_discount", "l_extendedprice", "tokens"),
)


def model_rows(spark, folder):
    return features.model_table(
        items(spark, folder),
        ROLES,
        {"month_name": fx.month_name("l_shipdate")},
        "tokens",
        {t: f"has_{t}" for t in NAME_TOKENS},
    )


@query(
    "model_table",
    f"""WITH {ITEMS}, clean AS (SELECT *, ';' || replace(tokens, ' ', '') || ';' AS t FROM items)
SELECT l_orderkey, period, flag, monthname(l_shipdate) AS month_name, l_returnflag, code, l_quantity, """
    + ", ".join(f"CAST(t LIKE '%;{t};%' AS INTEGER) AS has_{t}" for t in NAME_TOKENS)
    + " FROM clean",
)
def model_table(spark, folder):
    return model_rows(spark, folder)


@query(
    "check_model_table",
    f"""WITH {ORD}, t AS (SELECT o_orderkey, period, flag, o_orderstatus,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) + CAST(o_custkey % 100 = 0 AS INTEGER) AS urgent FROM ord WHERE o_orderstatus <> 'F')
SELECT 'column_order' AS "check", 0::BIGINT AS violations
UNION ALL SELECT 'missing_from_right', 0 UNION ALL SELECT 'missing_from_left', (SELECT count(*) FROM ord WHERE o_orderstatus = 'F')
UNION ALL SELECT 'period_mismatches', 0 UNION ALL SELECT 'flag_mismatches', 0
UNION ALL SELECT 'o_orderstatus not_null', 0 UNION ALL SELECT 'urgent not_null', 0
UNION ALL SELECT 'urgent binary', (SELECT count(*) FROM t WHERE urgent NOT IN (0, 1))""",
)
def check_model_table(spark, folder):
    source = orders(spark, folder)
    roles = features.Roles(("o_orderkey", "period"), "flag", ("o_orderstatus", "urgent"))
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int") + (
        F.col("o_custkey") % 100 == 0
    ).cast("int")
    table = features.model_table(source.where("o_orderstatus <> 'F'"), roles, {"urgent": urgent})
    return features.check_model_table(
        table, source, "o_orderkey", ["period", "flag"], roles, ["urgent"]
    )


# --- preprocessing ---------------------------------------------------------------------------

RECIPE = features.Recipe(("kind", "l_linestatus"), ("l_quantity",), ("late_line",))


def recipe_rows(spark, folder):
    """Line items whose ``kind`` has values that appear only later."""
    return late_kinds(spark, folder).withColumn("late_line", (F.col("l_linenumber") > 5).cast("int"))


@query(
    "one_hot",
    f"""WITH {LATE}, x AS (SELECT *, CAST(l_linenumber > 5 AS INTEGER) AS late_line FROM late),
tr AS (SELECT * FROM x WHERE period <= 1996), va AS (SELECT * FROM x WHERE period = 1997)
SELECT 'kind' AS predictor, kind AS level, (SELECT count(*) FROM va WHERE va.kind = tr.kind)::DOUBLE AS total FROM tr GROUP BY kind
UNION ALL SELECT 'l_linestatus', l_linestatus, (SELECT count(*) FROM va WHERE va.l_linestatus = tr.l_linestatus) FROM tr GROUP BY l_linestatus
UNION ALL SELECT 'late_line', '', (SELECT sum(late_line) FROM va)
UNION ALL SELECT 'l_quantity', '', (SELECT round(sum((l_quantity - (SELECT avg(l_quantity) FROM tr)) / (SELECT stddev_pop(l_quantity) FROM tr)), 6) FROM va)""",
)
def one_hot(spark, folder):
    """Column sums of the encoded validation rows; categories unseen in training add nothing."""
    rows = recipe_rows(spark, folder)
    model = features.fit_recipe(rows.where("period <= 1996"), RECIPE)
    encoded = model.transform(rows.where("period = 1997"))
    sums = (
        encoded.select(F.posexplode(vector_to_array("features")).alias("index", "x"))
        .groupBy("index")
        .agg(F.round(F.sum("x"), 6).alias("total"))
    )
    names = features.feature_map(encoded, RECIPE)
    return sums.join(names, "index").select("predictor", "level", "total")


@query(
    "feature_map",
    f"""WITH {LATE}, n AS (SELECT DISTINCT 'kind' AS predictor, kind AS level FROM late WHERE period <= 1996
  UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM late WHERE period <= 1996)
SELECT CAST(row_number() OVER (ORDER BY predictor, level) - 1 AS INTEGER) AS index, predictor,
  'categorical' AS predictor_group, level FROM n
UNION ALL SELECT CAST((SELECT count(*) FROM n) AS INTEGER), 'l_quantity', 'numeric', ''
UNION ALL SELECT CAST((SELECT count(*) + 1 FROM n) AS INTEGER), 'late_line', 'binary', ''""",
)
def feature_map(spark, folder):
    rows = recipe_rows(spark, folder)
    model = features.fit_recipe(rows.where("period <= 1996"), RECIPE)
    return features.feature_map(model.transform(rows), RECIPE).drop("feature")


@query(
    "check_matrix",
    f"""WITH {LATE} SELECT count(*) FILTER (WHERE period = 1997) AS rows,
  CAST((SELECT count(DISTINCT kind) + count(DISTINCT l_linestatus) + 2 FROM late WHERE period <= 1996) AS INTEGER) AS expected_width,
  0::BIGINT AS wrong_width_rows, 0::BIGINT AS non_finite_rows FROM late""",
)
def check_matrix(spark, folder):
    rows = recipe_rows(spark, folder)
    model = features.fit_recipe(rows.where("period <= 1996"), RECIPE)
    return features.check_matrix(model.transform(rows.where("period = 1997")), RECIPE)


@query(
    "standardize",
    f"""WITH {OCC}, m AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm,
  stddev_pop(l_extendedprice) AS ps FROM occ WHERE period <= 1998)
SELECT period, round(avg((l_quantity - qm) / qs), 6) AS quantity_mean, round(stddev_pop((l_quantity - qm) / qs), 6) AS quantity_deviation,
  round(avg((l_extendedprice - pm) / ps), 6) AS price_mean FROM occ, m GROUP BY period""",
)
def standardize(spark, folder):
    occ = occurrences(spark, folder)
    train = occ.where("period <= 1998")
    scaled = features.standardize(occ, train, ["l_quantity", "l_extendedprice"])
    return scaled.groupBy("period").agg(
        F.round(F.avg("l_quantity_scaled"), 6).alias("quantity_mean"),
        F.round(F.stddev_pop("l_quantity_scaled"), 6).alias("quantity_deviation"),
        F.round(F.avg("l_extendedprice_scaled"), 6).alias("price_mean"),
    )


UNKNOWN = f"""{LATE}, {FOLD_SQL}, long AS (SELECT 'kind' AS feature, kind AS value, period FROM late
  UNION ALL SELECT 'l_linestatus', l_linestatus, period FROM late
  UNION ALL SELECT 'day', CAST(day(l_shipdate) * 100 + month(l_shipdate) + l_suppkey * 10000 AS VARCHAR), period FROM late),
g AS (SELECT CAST(fold AS INTEGER) AS fold, feature, value, count(*) FILTER (WHERE side = 'train') AS train,
  count(*) FILTER (WHERE side = 'validation') AS validation FROM long JOIN f USING (period) GROUP BY ALL)"""
UNKNOWN_FEATURES = ["kind", "l_linestatus", "day"]


def unknown_rows(spark, folder):
    """``day`` is a code with many values, most of them new in each period."""
    code = F.day("l_shipdate") * 100 + F.month("l_shipdate") + F.col("l_suppkey") * 10000
    return late_kinds(spark, folder).withColumn("day", code.cast("string"))


@query(
    "unknown_audit",
    f"""WITH {UNKNOWN} SELECT fold, feature, count(*) FILTER (WHERE train > 0) AS train_categories,
  count(*) FILTER (WHERE validation > 0) AS validation_categories,
  count(*) FILTER (WHERE train = 0 AND validation > 0) AS unknown_categories,
  CAST(coalesce(sum(validation) FILTER (WHERE train = 0), 0) AS BIGINT) AS rows_with_unknown,
  round(coalesce(sum(validation) FILTER (WHERE train = 0), 0) / sum(validation) * 100, 6) AS unknown_share_percent
FROM g GROUP BY ALL""",
)
def unknown_audit(spark, folder):
    cells = features.fold_cells(unknown_rows(spark, folder), UNKNOWN_FEATURES, FOLDS)
    return features.unknown_audit(cells)


@query(
    "unknown_values",
    f"WITH {UNKNOWN} SELECT fold, feature, value, validation AS rows FROM g WHERE train = 0 AND validation > 0",
)
def unknown_values(spark, folder):
    cells = features.fold_cells(unknown_rows(spark, folder), UNKNOWN_FEATURES, FOLDS)
    return features.unknown_values(cells)


@query(
    "fold_preprocessing_summary",
    f"""WITH {UNKNOWN}, u AS (SELECT fold, feature, value FROM g WHERE train = 0 AND validation > 0),
v AS (SELECT CAST(fold AS INTEGER) AS fold, late.*, CAST(day(l_shipdate) * 100 + month(l_shipdate) + l_suppkey * 10000 AS VARCHAR) AS day
  FROM late JOIN f USING (period) WHERE side = 'validation'),
hits AS (SELECT v.fold, count(*) AS rows_with_any_unknown FROM v WHERE
  (fold, 'kind', kind) IN (SELECT (fold, feature, value) FROM u) OR (fold, 'day', day) IN (SELECT (fold, feature, value) FROM u) GROUP BY 1),
a AS (SELECT fold, count(*) FILTER (WHERE train > 0) AS categorical_outputs,
  CAST(coalesce(sum(validation) FILTER (WHERE train = 0), 0) AS BIGINT) AS unknown_occurrences FROM g GROUP BY 1),
n AS (SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE side = 'train') AS train_rows,
  count(*) FILTER (WHERE side = 'validation') AS validation_rows FROM late JOIN f USING (period) GROUP BY 1)
SELECT fold, train_rows, validation_rows, 5 AS input_predictors, categorical_outputs + 2 AS output_features,
  categorical_outputs, 1 AS numeric_outputs, 1 AS binary_outputs, unknown_occurrences,
  coalesce(rows_with_any_unknown, 0) AS rows_with_any_unknown FROM n JOIN a USING (fold) LEFT JOIN hits USING (fold)""",
)
def fold_preprocessing_summary(spark, folder):
    recipe = features.Recipe(tuple(UNKNOWN_FEATURES), ("l_quantity",), ("late_line",))
    return features.fold_preprocessing_summary(unknown_rows(spark, folder), recipe, FOLDS)

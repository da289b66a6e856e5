"""Drift between development years and the final year; contrasts between categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope.operators import contrast as ct
from ratescope.operators import drift, rates, statistics
from ratescope.plans.quality import CALENDAR_COVERAGE
from ratescope.plans.rates import late_kinds
from ratescope.plans.registry import query
from ratescope.plans.tables import (
    DEVELOPMENT,
    EV,
    FINAL,
    ITEMS,
    MEASURES,
    NAME_TOKENS,
    OCC,
    TOK,
    events,
    items,
    occurrences,
)
from ratescope.plans.rates import LATE

TVD = "round(0.5::DOUBLE * sum(abs(d / (SELECT sum(d) FROM c) - k / (SELECT sum(k) FROM c))), 9) AS tvd"


@query(
    "total_variation_distance",
    f"""WITH {OCC}, c AS (SELECT l_returnflag, count(*) FILTER (WHERE period <= 2000) AS d,
  count(*) FILTER (WHERE period = 2001) AS k FROM occ GROUP BY 1) SELECT {TVD} FROM c""",
)
def total_variation_distance(spark, folder):
    cells = (
        occurrences(spark, folder)
        .groupBy("l_returnflag")
        .agg(
            F.count_if(F.col("period") <= 2000).alias("d"),
            F.count_if(F.col("period") == FINAL).alias("k"),
        )
    )
    out = drift.total_variation_distance(cells, "d", "k")
    return out.withColumn("tvd", F.round("tvd", 9))


VARIABLES = ["kind", "l_linestatus", "l_linenumber", "l_suppkey", "gap"]


def drift_rows(spark, folder):
    gap = F.when(F.col("l_linenumber") > 3, F.col("l_linestatus"))
    return late_kinds(spark, folder).withColumn("gap", gap)


DRIFT_CELLS = f"""{LATE}, rows AS (SELECT *, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS gap FROM late),
long AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, coalesce(CAST({v} AS VARCHAR), '<NULL>') AS value, period FROM rows"
    for v in VARIABLES
) + """), n AS (SELECT count(*) FILTER (WHERE period <= 2000) AS dn, count(*) FILTER (WHERE period = 2001) AS cn FROM rows),
g AS (SELECT variable, value, count(*) FILTER (WHERE period <= 2000) AS d,
  count(*) FILTER (WHERE period = 2001) AS c, min(period) AS first_period FROM long GROUP BY ALL),
s AS (SELECT g.*, d / dn AS ds, c / cn AS cs, abs((c / cn - d / dn) * 100) AS change, dn, cn FROM g, n)"""


@query(
    "categorical_drift",
    f"""WITH {DRIFT_CELLS}, top AS (SELECT * FROM s QUALIFY row_number() OVER (
  PARTITION BY variable ORDER BY change DESC, value) = 1),
a AS (SELECT variable, round(sum(abs(ds - cs)) / 2, 9) AS tvd,
  count(*) FILTER (WHERE d > 0) AS development_categories, count(*) FILTER (WHERE c > 0) AS comparison_categories,
  count(*) FILTER (WHERE d > 0 AND c > 0) AS shared_categories,
  count(*) FILTER (WHERE d = 0 AND c > 0) AS new_categories,
  count(*) FILTER (WHERE d > 0 AND c = 0) AS missing_categories,
  CAST(coalesce(sum(c) FILTER (WHERE d = 0), 0) AS BIGINT) AS new_rows,
  round(coalesce(sum(c) FILTER (WHERE d = 0), 0) / any_value(cn) * 100, 9) AS new_share_percent FROM s GROUP BY 1)
SELECT a.*, top.value AS largest_change_category, round(change, 9) AS largest_change_points,
  round(ds * 100, 9) AS development_share_percent, round(cs * 100, 9) AS comparison_share_percent
FROM a JOIN top USING (variable)""",
)
def categorical_drift(spark, folder):
    return drift.categorical_drift(drift_rows(spark, folder), VARIABLES, DEVELOPMENT, [FINAL])


@query(
    "new_categories",
    f"""WITH {DRIFT_CELLS} SELECT variable, value AS category, c AS comparison_rows,
  round(c / cn * 100, 9) AS comparison_share_percent, first_period FROM s WHERE d = 0 AND c > 0""",
)
def new_categories(spark, folder):
    return drift.new_categories(drift_rows(spark, folder), VARIABLES, DEVELOPMENT, [FINAL])


CONTINUOUS = ["l_extendedprice", "l_tax"]
DECILE = [i / 10 for i in range(1, 10)]


def _edges(column: str) -> str:
    qs = ", ".join(f"quantile_cont({column}, {p})" for p in DECILE)
    return f"SELECT '{column}' AS variable, list_sort(list_distinct([{qs}])) AS edges FROM occ WHERE period <= 2000"


EDGES = f"e AS ({' UNION ALL '.join(_edges(c) for c in CONTINUOUS)})"


@query(
    "quantile_edges",
    f"""WITH {OCC}, {EDGES} SELECT variable, CAST(i AS INTEGER) AS edge, round(edges[i], 6) AS value
FROM (SELECT variable, edges, unnest(range(1, len(edges) + 1)) AS i FROM e)""",
)
def quantile_edges(spark, folder):
    development = occurrences(spark, folder).where(F.col("period") <= 2000)
    edges = statistics.quantile_edges(development, CONTINUOUS)
    return edges.select("variable", F.posexplode("edges").alias("edge", "value")).select(
        "variable", (F.col("edge") + 1).alias("edge"), F.round("value", 6).alias("value")
    )


BINS = """long AS (SELECT 'l_extendedprice' AS variable, l_extendedprice AS value, period FROM occ
  UNION ALL SELECT 'l_tax', l_tax, period FROM occ),
binned AS (SELECT variable, period, CAST(len(list_filter(edges, lambda x: x <= value)) AS INTEGER) AS bin
  FROM long JOIN e USING (variable))"""


@query(
    "apply_bins",
    f"""WITH {OCC}, {EDGES}, {BINS} SELECT CASE WHEN period <= 2000 THEN 'development' ELSE 'comparison' END AS side,
  variable, bin, count(*) AS rows FROM binned GROUP BY ALL""",
)
def apply_bins(spark, folder):
    occ = occurrences(spark, folder)
    edges = statistics.quantile_edges(occ.where(F.col("period") <= 2000), CONTINUOUS)
    cells = drift.side_cells(occ, CONTINUOUS, DEVELOPMENT, [FINAL], "period")
    return drift.apply_bins(cells, edges, ["side"])


def _stats(column: str, prefix: str, test: str) -> str:
    f = f"FILTER (WHERE {test})"
    parts = [f"count({column}) {f} AS {prefix}_n", f"round(avg({column}) {f}, 6) AS {prefix}_mean"]
    parts += [f"min({column}) {f} AS {prefix}_minimum", f"max({column}) {f} AS {prefix}_maximum"]
    for name, p in statistics.QUARTILES_AND_TAIL.items():
        parts.append(f"round(quantile_cont({column}, {p}) {f}, 6) AS {prefix}_{name}")
    return ", ".join(parts)


NUMERIC = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {_stats(c, 'development', 'period <= 2000')}, {_stats(c, 'comparison', 'period = 2001')} FROM occ"
    for c in (*CONTINUOUS, "l_quantity")
)


@query(
    "numeric_drift",
    f"""WITH {OCC}, {EDGES}, {BINS}, stats AS ({NUMERIC}),
cells AS (SELECT variable, CAST(bin AS DOUBLE) AS v, period FROM binned
  UNION ALL SELECT 'l_quantity', l_quantity, period FROM occ),
g AS (SELECT variable, v, count(*) FILTER (WHERE period <= 2000) AS d, count(*) FILTER (WHERE period = 2001) AS c
  FROM cells GROUP BY ALL),
t AS (SELECT variable, sum(d) AS dn, sum(c) AS cn FROM g GROUP BY 1),
tv AS (SELECT variable, round(sum(abs(d / dn - c / cn)) / 2, 9) AS distribution_tvd FROM g JOIN t USING (variable) GROUP BY 1)
SELECT stats.*, distribution_tvd, CAST(len(edges) + 1 AS INTEGER) AS development_bin_count,
  CASE WHEN edges IS NULL THEN 'discrete_exact_tvd' ELSE 'development_decile_binned_tvd' END AS audit_method
FROM stats JOIN tv USING (variable) LEFT JOIN e USING (variable)""",
)
def numeric_drift(spark, folder):
    out = drift.numeric_drift(
        occurrences(spark, folder), CONTINUOUS, ["l_quantity"], DEVELOPMENT, [FINAL]
    ).drop("development_edges")
    keep = {"distribution_tvd", "development_bin_count", "development_n", "comparison_n"}
    numbers = [c for c, t in out.dtypes if t == "double" and c not in keep]
    # Adding 0.0 prints a minimum of -0.0 as 0.0.
    return out.withColumns({c: F.round(F.col(c) + 0.0, 6) for c in numbers})


@query(
    "multilabel_drift",
    f"""WITH {TOK}, kept AS (SELECT * FROM tok WHERE NOT (token = 'hot' AND period = 2001) AND NOT (token = 'rod' AND period < 2001)),
base AS (SELECT count(*) FILTER (WHERE period <= 2000) AS dn, count(*) FILTER (WHERE period = 2001) AS cn FROM items),
g AS (SELECT token, count(*) FILTER (WHERE period <= 2000) AS d, count(*) FILTER (WHERE period = 2001) AS c,
  string_agg(DISTINCT CAST(period AS VARCHAR), '|' ORDER BY CAST(period AS VARCHAR)) AS periods_present FROM kept GROUP BY 1)
SELECT token, d AS development_rows, round(d / dn * 100, 9) AS development_prevalence_percent,
  c AS comparison_rows, round(c / cn * 100, 9) AS comparison_prevalence_percent,
  round(c / cn * 100 - d / dn * 100, 9) AS difference_points,
  round(abs(c / cn * 100 - d / dn * 100), 9) AS absolute_difference_points, periods_present,
  CASE WHEN d = 0 THEN 'new' WHEN c = 0 THEN 'missing' ELSE 'shared' END AS presence FROM g, base""",
)
def multilabel_drift(spark, folder):
    no_hot = F.regexp_replace("tokens", "hot", "")
    no_rod = F.regexp_replace("tokens", "rod", "")
    field = F.when(F.col("period") == FINAL, no_hot).otherwise(no_rod)
    changed = items(spark, folder).withColumn("tokens", field)
    known = [*NAME_TOKENS, ""]
    out = drift.multilabel_drift(changed, "tokens", DEVELOPMENT, [FINAL], known=known)
    return out.where("token <> ''")


MODE_VARIABLES = ["l_returnflag", "l_linenumber", "gap"]


@query(
    "annual_mode",
    f"""WITH {OCC}, rows AS (SELECT *, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS gap FROM occ), long AS ("""
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS value, period FROM rows" for v in MODE_VARIABLES
    )
    + """), g AS (SELECT variable, period, coalesce(value, '<NULL>') AS label, value IS NOT NULL AS filled, count(*) AS n FROM long GROUP BY ALL)
SELECT variable, period, CAST(coalesce(sum(n) FILTER (WHERE filled), 0) AS BIGINT) AS non_null_rows, count(*) AS distinct_values,
  first(label ORDER BY n DESC, label) AS top_category, max(n) AS top_category_rows,
  round(max(n) / sum(n) * 100, 9) AS top_category_share_percent FROM g GROUP BY variable, period""",
)
def annual_mode(spark, folder):
    gap = F.when(F.col("l_linenumber") > 3, F.col("l_linestatus"))
    return drift.annual_mode(occurrences(spark, folder).withColumn("gap", gap), MODE_VARIABLES)


@query(
    "annual_profile",
    f"""WITH {EV}, parsed AS (SELECT period, date_text AS day_text, CAST(date_text AS DATE) AS d, monthname(ts) AS month_name FROM ev),
cov AS (SELECT * REPLACE ('date_text' AS variable, coalesce(missing_months, '') AS missing_months) FROM ({CALENDAR_COVERAGE})),
modes AS (SELECT period, event_type, count(*) AS n FROM ev GROUP BY ALL)
SELECT 'event_type' AS variable, period, CAST(sum(n) AS BIGINT) AS non_null_rows, NULL::BIGINT AS parseable_rows,
  count(*) AS distinct_values, NULL::INTEGER AS covered_months, NULL AS missing_months, NULL AS minimum_value,
  NULL AS maximum_value, NULL::BIGINT AS consistent_rows, first(event_type ORDER BY n DESC, event_type) AS top_category,
  max(n) AS top_category_rows, round(max(n) / sum(n) * 100, 9) AS top_category_share_percent FROM modes GROUP BY period
UNION ALL BY NAME SELECT * FROM cov
UNION ALL BY NAME SELECT 'time_text' AS variable, period, count(*) AS non_null_rows, count(*) AS parseable_rows,
  count(DISTINCT time_text) AS distinct_values, min(time_text) AS minimum_value, max(time_text) AS maximum_value,
  count(*) AS consistent_rows FROM ev GROUP BY period""",
)
def annual_profile(spark, folder):
    rows = events(spark, folder).withColumn("month_name", fx.month_name("ts"))
    label = fx.month_name(F.col("date_text").try_cast("date"))
    return drift.annual_profile(
        rows, ["event_type"], "date_text", "month_name", label, "time_text", "hour"
    )


# --- contrasts -------------------------------------------------------------------------------

CONTRAST_DIMENSIONS = ["l_returnflag", "l_linestatus", "l_linenumber", "code"]
EVIDENCE = f"""{ITEMS}, long AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS dimension, CAST({v} AS VARCHAR) AS category, period, flag FROM items"
    for v in CONTRAST_DIMENSIONS
) + f"""), by_p AS (SELECT dimension, category, period, {MEASURES} FROM long GROUP BY ALL),
ev AS (SELECT dimension, category, CAST(sum(total) AS BIGINT) AS total,
  round(sum(flagged) / sum(total) * 100, 6) AS rate_percent, count(*) AS periods_observed,
  min(rate_percent) AS minimum_rate_percent, max(rate_percent) AS maximum_rate_percent,
  round(max(rate_percent) - min(rate_percent), 6) AS range_points FROM by_p GROUP BY ALL)"""
ROW = """category, total, rate_percent, periods_observed, minimum_rate_percent, maximum_rate_percent, range_points"""


def _pick(dimension: str, order: str, where: str = "true") -> str:
    return f"(SELECT {ROW} FROM ev WHERE dimension = '{dimension}' AND {where} ORDER BY {order}, category LIMIT 1)"


def _contrast_sql(dimension: str, focal: str, reference: str, priority: str, minimum: int = 500) -> str:
    return f"""SELECT '{dimension}' AS dimension, f.category || ' vs ' || r.category AS comparison,
  f.category AS focal_category, f.total, f.rate_percent, r.category AS reference_category,
  r.total AS reference_total, r.rate_percent AS reference_rate_percent,
  round(abs(f.rate_percent - r.rate_percent), 6) AS difference_points, f.periods_observed,
  f.minimum_rate_percent, f.maximum_rate_percent, f.range_points,
  CASE WHEN least(f.total, r.total) >= {minimum} THEN 'sufficient' ELSE 'small_sample' END AS sample_flag,
  '{priority}' AS priority, true AS substantive FROM {focal} f, {reference} r"""


def _quality_sql(dimension: str, value: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, category || ' (special category)' AS comparison,
  category AS focal_category, total, rate_percent, NULL::VARCHAR AS reference_category, NULL::BIGINT AS reference_total,
  NULL::DOUBLE AS reference_rate_percent, NULL::DOUBLE AS difference_points, periods_observed,
  minimum_rate_percent, maximum_rate_percent, range_points, 'data_quality' AS sample_flag,
  'data quality' AS priority, false AS substantive FROM ev WHERE dimension = '{dimension}' AND category = '{value}'"""


GLOBAL = f"""SELECT 'overall' AS dimension, 'highest period rate vs lowest period rate' AS comparison,
  'highest period rate' AS focal_category, CAST(sum(total) AS BIGINT) AS total, max(rate_percent) AS rate_percent,
  'lowest period rate' AS reference_category, NULL::BIGINT AS reference_total, min(rate_percent) AS reference_rate_percent,
  round(max(rate_percent) - min(rate_percent), 6) AS difference_points, count(*) AS periods_observed,
  min(rate_percent) AS minimum_rate_percent, max(rate_percent) AS maximum_rate_percent,
  round(max(rate_percent) - min(rate_percent), 6) AS range_points, 'whole_table' AS sample_flag,
  'contextual' AS priority, true AS substantive FROM (SELECT period, {MEASURES} FROM items GROUP BY 1)"""

MATRIX_SQL = " UNION ALL ".join(
    [
        GLOBAL,
        _contrast_sql(
            "l_returnflag", _pick("l_returnflag", "rate_percent DESC"), _pick("l_returnflag", "rate_percent"), "secondary"
        ),
        _contrast_sql(
            "l_linestatus",
            _pick("l_linestatus", "1", "category = 'O'"),
            _pick("l_linestatus", "1", "category = 'F'"),
            "central",
        ),
        _contrast_sql(
            "code",
            _pick("code", "rate_percent DESC", "total >= 100 AND category <> '0'"),
            _pick("code", "total DESC"),
            "central",
        ),
        _contrast_sql(
            "l_linenumber",
            _pick("l_linenumber", "CAST(category AS DOUBLE) DESC"),
            _pick("l_linenumber", "CAST(category AS DOUBLE)"),
            "secondary",
        ),
        _quality_sql("code", "0"),
    ]
)


def matrix(spark, folder):
    base = items(spark, folder)
    pick, contrast = ct.Pick, ct.Contrast
    specs = [
        contrast("l_returnflag", pick("highest_rate"), pick("lowest_rate")),
        contrast("l_linestatus", pick("value", "O"), pick("value", "F"), "central"),
        contrast(
            "code",
            pick("highest_rate", minimum_rows=100, excluded=(0,)),
            pick("highest_volume"),
            "central",
        ),
        contrast("l_linenumber", pick("largest_value"), pick("smallest_value")),
        contrast("code", pick("value", 0), None, "data quality"),
    ]
    return ct.contrast_matrix(base, specs, overall=True)


query("contrast_matrix", f"WITH {EVIDENCE} {MATRIX_SQL}")(matrix)


@query("global_row", f"WITH {ITEMS} {GLOBAL}")
def global_row(spark, folder):
    return ct.global_row(rates.period_summary(items(spark, folder)))


@query("quality_row", f"WITH {EVIDENCE} {_quality_sql('code', '0')}")
def quality_row(spark, folder):
    return ct.quality_rows(items(spark, folder), {"code": 0})


@query(
    "contrast",
    f"WITH {EVIDENCE} "
    + _contrast_sql(
        "l_linenumber",
        _pick("l_linenumber", "1", "category = '7'"),
        _pick("l_linenumber", "1", "category = '1'"),
        "secondary",
    ),
)
def contrast(spark, folder):
    return ct.contrast(items(spark, folder), "l_linenumber", 7, 1)


@query("core_findings", f"WITH {EVIDENCE}, m AS ({MATRIX_SQL}) SELECT * FROM m WHERE priority = 'central'")
def core_findings(spark, folder):
    return ct.core_findings(matrix(spark, folder))


@query(
    "consistency",
    f"""WITH {EVIDENCE}, m AS ({MATRIX_SQL}) SELECT dimension, comparison, periods_observed, minimum_rate_percent,
  maximum_rate_percent, range_points, priority FROM m WHERE substantive""",
)
def consistency(spark, folder):
    return ct.consistency(matrix(spark, folder))

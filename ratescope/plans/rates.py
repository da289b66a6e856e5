"""Rates, stability, lifecycles, rankings, multi-valued fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope.operators import joins, lifecycle, ranking, rates, statistics, tokens
from ratescope.plans.registry import query
from ratescope.plans.tables import (
    ITEMS,
    MEASURES,
    NAME_TOKENS,
    OCC,
    ORD,
    PLACES,
    PRIORITIES,
    TOK,
    items,
    occurrences,
    orders,
    places,
    summary_sql,
)

BY_FLAG = f"by_period AS (SELECT period, l_returnflag, {MEASURES} FROM occ GROUP BY ALL)"
SPREAD = """count(DISTINCT period) AS periods_observed, min(rate_percent) AS minimum_rate_percent,
  max(rate_percent) AS maximum_rate_percent,
  round(max(rate_percent) - min(rate_percent), 6) AS range_points"""


def severity_by_category(spark, folder):
    """Rate per category with its spread over the years, highest rate first."""
    summary = rates.rate_with_stability(occurrences(spark, folder), "l_returnflag")
    return summary.orderBy(F.desc("rate_percent"), "l_returnflag")


query(
    "severity_by_category",
    f"""WITH {OCC}, {BY_FLAG}, summary AS ({summary_sql('occ', 'l_returnflag')}),
spread AS (SELECT l_returnflag, {SPREAD} FROM by_period GROUP BY 1)
SELECT * FROM summary LEFT JOIN spread USING (l_returnflag)""",
)(severity_by_category)


@query("rate_summary", f"WITH {OCC} {summary_sql('occ', 'l_returnflag, l_linestatus')}")
def rate_summary(spark, folder):
    return rates.rate_summary(occurrences(spark, folder), ["l_returnflag", "l_linestatus"])


@query("rate_summary_by_supplier", f"WITH {OCC} {summary_sql('occ', 'l_suppkey')}")
def rate_summary_by_supplier(spark, folder):
    return rates.rate_summary(occurrences(spark, folder), "l_suppkey")


@query("rate_summary_places", f"WITH {PLACES} {summary_sql('places', 'r_name, n_name')}")
def rate_summary_places(spark, folder):
    return rates.rate_summary(places(spark, folder), ["r_name", "n_name"])


@query("sort_by_order", f"WITH {ORD} {summary_sql('ord', 'o_orderpriority')}")
def sort_by_order(spark, folder):
    return rates.rate_summary(orders(spark, folder), "o_orderpriority", order=PRIORITIES)


@query("rate_by_period", f"WITH {OCC} SELECT period, l_returnflag, {MEASURES} FROM occ GROUP BY ALL")
def rate_by_period(spark, folder):
    return rates.rate_by_period(occurrences(spark, folder), "l_returnflag")


@query(
    "join_period_totals",
    f"""WITH {OCC}, t AS (SELECT period, count(*) AS n FROM occ GROUP BY 1)
SELECT period, l_returnflag, {MEASURES},
  round(count(*) / any_value(n) * 100, 6) AS period_share_percent
FROM occ JOIN t USING (period) GROUP BY period, l_returnflag""",
)
def join_period_totals(spark, folder):
    return rates.rate_by_period(occurrences(spark, folder), "l_returnflag", with_share=True)


PERIOD_SUMMARY = f"""p AS (SELECT period, {MEASURES},
  round(count(*) FILTER (WHERE NOT flag) / count(*) * 100, 6) AS unflagged_rate_percent,
  round(count(*) / (SELECT count(*) FROM occ) * 100, 6) AS share_percent
  FROM occ GROUP BY period)"""


@query(
    "period_summary",
    f"""WITH {OCC}, {PERIOD_SUMMARY} SELECT *,
  round((total / lag(total) OVER (ORDER BY period) - 1) * 100, 6) AS change_percent FROM p""",
)
def period_summary(spark, folder):
    return rates.period_summary(occurrences(spark, folder))


@query(
    "period_change",
    f"""WITH {ORD}, p AS (SELECT period, count(*) AS total FROM ord GROUP BY 1)
SELECT period, total,
  round((total / lag(total) OVER (ORDER BY period) - 1) * 100, 6) AS change_percent FROM p""",
)
def period_change(spark, folder):
    summary = rates.period_summary(orders(spark, folder))
    return summary.select("period", "total", "change_percent")


@query(
    "rate_range",
    f"""WITH {OCC}, {PERIOD_SUMMARY} SELECT min(rate_percent) AS minimum_rate_percent,
  max(rate_percent) AS maximum_rate_percent,
  round(max(rate_percent) - min(rate_percent), 6) AS range_points,
  round(avg(rate_percent), 6) AS mean_rate_percent,
  round(sum(flagged) / sum(total) * 100, 6) AS weighted_rate_percent FROM p""",
)
def rate_range(spark, folder):
    out = rates.rate_range(rates.period_summary(occurrences(spark, folder)))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("mean_rate_percent", "weighted_rate_percent")}
    )


@query(
    "stability",
    f"""WITH {OCC}, {BY_FLAG},
b2 AS (SELECT period, l_linenumber, {MEASURES} FROM occ GROUP BY ALL)
SELECT 'return flag' AS dimension, l_returnflag AS category, {SPREAD} FROM by_period GROUP BY 2
UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), {SPREAD} FROM b2 GROUP BY 2""",
)
def stability(spark, folder):
    dimensions = {"return flag": "l_returnflag", "line": "l_linenumber"}
    return rates.stability_from_cells(rates.dimension_cells(occurrences(spark, folder), dimensions))


LATE = f"""{OCC}, late AS (SELECT *, CASE WHEN period < 1997 AND l_linenumber = 1 THEN 'early only'
  WHEN period = 2001 AND l_linenumber = 2 THEN 'last only'
  WHEN period > 1996 AND l_linenumber = 3 THEN 'late'
  ELSE l_returnflag END AS kind FROM occ)"""


def late_kinds(spark, folder):
    """Categories that come and go."""
    line, period = F.col("l_linenumber"), F.col("period")
    return occurrences(spark, folder).withColumn(
        "kind",
        F.when((period < 1997) & (line == 1), "early only")
        .when((period == 2001) & (line == 2), "last only")
        .when((period > 1996) & (line == 3), "late")
        .otherwise(F.col("l_returnflag")),
    )


@query(
    "stability_filtered",
    f"""WITH {LATE}, b AS (SELECT period, kind, {MEASURES} FROM late GROUP BY ALL),
s AS (SELECT kind, {SPREAD}, CAST(sum(total) AS BIGINT) AS total FROM b GROUP BY 1)
SELECT 'kind' AS dimension, kind AS category, periods_observed, total, minimum_rate_percent,
  maximum_rate_percent, range_points,
  periods_observed = (SELECT count(DISTINCT period) FROM late) AND total >= 500 AS priority
FROM s WHERE periods_observed >= 3""",
)
def stability_filtered(spark, folder):
    return lifecycle.stability_filtered(late_kinds(spark, folder), {"kind": "kind"})


@query(
    "join_attributes",
    f"""WITH {LATE}, b AS (SELECT period, kind, {MEASURES} FROM late GROUP BY ALL),
s AS (SELECT kind, {SPREAD} FROM b GROUP BY 1),
v AS (SELECT kind, count(*) AS volume FROM late WHERE period < 1997 GROUP BY 1)
SELECT * FROM s LEFT JOIN v USING (kind)""",
)
def join_attributes(spark, folder):
    late = late_kinds(spark, folder)
    spread = rates.rate_spread(rates.rate_by_period(late, "kind"), ["kind"], "period")
    volume = late.where("period < 1997").groupBy("kind").agg(F.count(F.lit(1)).alias("volume"))
    return joins.attach_attributes(spread.drop("total"), volume, ["kind"])


LIFE = """life AS (SELECT 'kind' AS dimension, kind AS category, min(period) AS first_period,
  max(period) AS last_period, count(DISTINCT period) AS periods_observed, count(*) AS total,
  count(DISTINCT period) = (SELECT count(DISTINCT period) FROM late) AS present_all_periods,
  count(DISTINCT period) = 1 AS only_one_period,
  min(period) > (SELECT min(period) FROM late) AS appears_later,
  max(period) < (SELECT max(period) FROM late) AS disappears_earlier FROM late GROUP BY kind)"""


@query("category_lifecycle", f"WITH {LATE}, {LIFE} SELECT * FROM life")
def category_lifecycle(spark, folder):
    return lifecycle.category_lifecycle(late_kinds(spark, folder), {"kind": "kind"})


@query(
    "taxonomy_diagnostics",
    f"""WITH {LATE}, {LIFE}, d AS (SELECT period, count(DISTINCT kind) AS n FROM late GROUP BY 1)
SELECT 'kind' AS dimension, 'period' AS scope, period, n AS distinct_categories,
  (SELECT count(*) FROM life WHERE first_period = period) AS first_seen,
  (SELECT count(*) FROM life WHERE last_period = period) AS last_seen,
  NULL::BIGINT AS union_categories, NULL::BIGINT AS present_all_periods,
  NULL::BIGINT AS only_one_period, NULL::BIGINT AS appears_later,
  NULL::BIGINT AS disappears_earlier FROM d
UNION ALL SELECT 'kind', 'overall', NULL, NULL, NULL, NULL, count(*),
  count(*) FILTER (WHERE present_all_periods), count(*) FILTER (WHERE only_one_period),
  count(*) FILTER (WHERE appears_later), count(*) FILTER (WHERE disappears_earlier) FROM life""",
)
def taxonomy_diagnostics(spark, folder):
    return lifecycle.taxonomy_diagnostics(late_kinds(spark, folder), {"kind": "kind"})


@query("value_distribution", f"WITH {OCC} {summary_sql('occ', 'l_quantity')}")
def value_distribution(spark, folder):
    return rates.value_distribution(occurrences(spark, folder), "l_quantity")


NEAREST = """CAST(floor((count(*) - 1) * {p}::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1"""


def _nearest(p: str) -> str:
    return f"list_sort(list(l_quantity))[{NEAREST.format(p=p)}]"


@query(
    "numeric_summary_nearest",
    f"""WITH s AS (SELECT 'l_quantity' AS variable, min(l_quantity) AS minimum,
  {_nearest('0.25')} AS p25, quantile_cont(l_quantity, 0.5) AS median, avg(l_quantity) AS mean,
  {_nearest('0.75')} AS p75, {_nearest('0.9')} AS p90, {_nearest('0.95')} AS p95,
  {_nearest('0.99')} AS p99, max(l_quantity) AS maximum FROM lineitem)
SELECT * REPLACE (round(mean, 6) AS mean),
  (SELECT count(*) FROM lineitem WHERE l_quantity > p99) AS rows_above_p99 FROM s""",
)
def numeric_summary_nearest(spark, folder):
    out = statistics.numeric_summary_nearest(occurrences(spark, folder), ["l_quantity"])
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "numeric_summary_linear",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) AS n, min({c}) AS minimum,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.9), 6) AS p90,
  round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99,
  round(avg({c}), 6) AS mean, max({c}) AS maximum FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def numeric_summary_linear(spark, folder):
    out = statistics.numeric_summary_linear(
        occurrences(spark, folder), ["l_quantity", "l_extendedprice"]
    )
    rounded = ["p25", "median", "p75", "p90", "p95", "p99", "mean"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "calendar_rate",
    f"""WITH {OCC}, m AS (SELECT *, CAST(month(l_shipdate) AS INTEGER) AS month FROM occ),
s AS ({summary_sql('m', 'month')}),
g AS (SELECT m.month, y.period FROM (SELECT unnest(range(1, 13)) AS month) m,
  (SELECT DISTINCT period FROM occ) y),
d AS (SELECT month, CAST(sum(day(last_day(make_date(period, month, 1)))) AS BIGINT) AS calendar_days
  FROM g GROUP BY 1)
SELECT s.*, calendar_days, round(total / calendar_days, 6) AS rows_per_calendar_day
FROM s JOIN d ON s.month = d.month""",
)
def calendar_rate(spark, folder):
    occ = occurrences(spark, folder).withColumn("month", F.month("l_shipdate"))
    return rates.calendar_rate(occ, "month")


@query(
    "calendar_days",
    """WITH g AS (SELECT CAST(m.month AS INTEGER) AS month, y.period
  FROM (SELECT unnest(range(1, 13)) AS month) m,
  (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS period FROM lineitem) y)
SELECT month, CAST(sum(day(last_day(make_date(period, month, 1)))) AS BIGINT) AS calendar_days
FROM g GROUP BY 1""",
)
def calendar_days(spark, folder):
    return rates.calendar_days(occurrences(spark, folder))


@query(
    "reconcile_totals",
    f"""WITH {OCC}, s AS ({summary_sql('occ', 'l_returnflag')})
SELECT 'by return flag' AS summary, (SELECT count(*) FROM occ) AS table_rows,
  CAST(sum(total) AS BIGINT) AS group_rows,
  sum(total) = (SELECT count(*) FROM occ) AS rows_match,
  count(*) FILTER (WHERE flagged + unflagged <> total) AS class_mismatches FROM s""",
)
def reconcile_totals(spark, folder):
    occ = occurrences(spark, folder)
    return rates.reconcile_totals(occ, rates.rate_summary(occ, "l_returnflag"), "by return flag")


# --- rankings --------------------------------------------------------------------------------

CODES = f"{ITEMS}, codes AS ({summary_sql('items', 'code')})"
KEPT = "code, total, flagged, rate_percent"


@query(
    "top_by_volume",
    f"WITH {CODES} SELECT {KEPT} FROM codes WHERE code <> 0 ORDER BY total DESC, code LIMIT 15",
)
def top_by_volume(spark, folder):
    summary = rates.rate_summary(items(spark, folder), "code")
    return ranking.top_by_volume(summary, "code", excluded={"code": [0]})


@query(
    "top_by_rate",
    f"""WITH {CODES} SELECT {KEPT} FROM codes WHERE total >= 500 AND code <> 0
ORDER BY rate_percent DESC, total DESC, code LIMIT 15""",
)
def top_by_rate(spark, folder):
    summary = rates.rate_summary(items(spark, folder), "code")
    return ranking.top_by_rate(summary, "code", excluded={"code": [0]})


@query(
    "rate_highlights",
    f"WITH {ORD}, s AS ({summary_sql('ord', 'o_orderpriority')}) SELECT o_orderpriority, total, flagged,"
    " rate_percent FROM s WHERE total >= 500 AND o_orderpriority <> '4-NOT SPECIFIED'",
)
def rate_highlights(spark, folder):
    summary = rates.rate_summary(orders(spark, folder), "o_orderpriority")
    excluded = {"o_orderpriority": ["4-NOT SPECIFIED"]}
    return ranking.rate_highlights(summary, "o_orderpriority", excluded=excluded)


@query(
    "value_highlights",
    f"WITH {OCC}, s AS ({summary_sql('occ', 'l_quantity')}) SELECT l_quantity, total, flagged,"
    " rate_percent FROM s WHERE total >= 500",
)
def value_highlights(spark, folder):
    distribution = rates.value_distribution(occurrences(spark, folder), "l_quantity")
    return ranking.value_highlights(distribution, "l_quantity")


@query(
    "rate_extreme",
    f"""WITH {CODES} SELECT
  (SELECT code FROM codes ORDER BY rate_percent DESC, code LIMIT 1) AS highest_category,
  max(rate_percent) AS highest_rate_percent,
  (SELECT code FROM codes ORDER BY rate_percent, code LIMIT 1) AS lowest_category,
  min(rate_percent) AS lowest_rate_percent FROM codes""",
)
def rate_extreme(spark, folder):
    return ranking.rate_extreme(rates.rate_summary(items(spark, folder), "code"), "code")


@query(
    "sort_mixed",
    f"""WITH {OCC}, {PERIOD_SUMMARY} SELECT period, total,
  round((total / lag(total) OVER (ORDER BY period) - 1) * 100, 6) AS change_percent FROM p""",
)
def sort_mixed(spark, folder):
    summary = rates.period_summary(occurrences(spark, folder))
    return ranking.sort_mixed(
        summary.select("period", "total", "change_percent"),
        [("change_percent", "desc"), ("period", "asc")],
    )


@query(
    "threshold_diagnostics",
    f"""WITH {CODES}, pl AS (SELECT l_suppkey, count(*) AS total FROM occ GROUP BY 1),
t AS (SELECT unnest([100, 500, 1000]) AS minimum_rows)
SELECT 'code' AS dimension, CAST(minimum_rows AS INTEGER) AS minimum_rows,
  (SELECT count(*) FROM codes WHERE code <> 0 AND total >= minimum_rows) AS eligible_categories FROM t
UNION ALL SELECT 'supplier', CAST(minimum_rows AS INTEGER),
  (SELECT count(*) FROM pl WHERE total >= minimum_rows) FROM t""",
)
def threshold_diagnostics(spark, folder):
    cells = rates.dimension_cells(items(spark, folder), {"code": "code", "supplier": "l_suppkey"})
    return ranking.eligible_from_cells(cells, excluded={"code": ["0"]})


# --- multi-valued fields ---------------------------------------------------------------------

@query("explode_tokens", f"WITH {TOK} SELECT period, flag, token, count(*) AS n FROM tok GROUP BY ALL")
def explode_tokens(spark, folder):
    exploded = tokens.explode_tokens(
        items(spark, folder), "tokens", ["period", "flag"], NAME_TOKENS
    )
    return exploded.groupBy("period", "flag", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_rate_summary",
    f"""WITH {TOK} SELECT token, {MEASURES},
  round(count(*) / (SELECT count(*) FROM items) * 100, 6) AS containing_percent
FROM tok GROUP BY token""",
)
def token_rate_summary(spark, folder):
    return tokens.token_rate_summary(items(spark, folder), "tokens", known=NAME_TOKENS)


@query(
    "token_rate_by_period",
    f"""WITH {TOK}, n AS (SELECT period, count(*) AS rows FROM items GROUP BY 1)
SELECT period, token, {MEASURES}, round(count(*) / any_value(rows) * 100, 6) AS containing_percent
FROM tok JOIN n USING (period) GROUP BY period, token""",
)
def token_rate_by_period(spark, folder):
    return tokens.token_rate_by_period(items(spark, folder), "tokens", known=NAME_TOKENS)


@query("token_list", f"WITH {TOK} SELECT DISTINCT token, token <> 'rod' AS expected FROM tok")
def token_list(spark, folder):
    known = [t for t in NAME_TOKENS if t != "rod"]
    return tokens.token_list(items(spark, folder), "tokens", known)


@query(
    "token_indicators",
    f"""WITH {ITEMS} SELECT period,
  CAST(sum(CASE WHEN ';' || replace(tokens, ' ', '') || ';' LIKE '%;hot;%' THEN 1 ELSE 0 END) AS BIGINT) AS has_hot,
  CAST(sum(CASE WHEN ';' || replace(tokens, ' ', '') || ';' LIKE '%;ring;%' THEN 1 ELSE 0 END) AS BIGINT) AS has_ring
FROM items GROUP BY period""",
)
def token_indicators(spark, folder):
    wide = tokens.token_indicators(
        items(spark, folder), "tokens", {"hot": "has_hot", "ring": "has_ring"}
    )
    return wide.groupBy("period").agg(
        F.sum("has_hot").alias("has_hot"), F.sum("has_ring").alias("has_ring")
    )

"""Rules, uniqueness, profiles, coverage, content comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope.operators import quality as dq
from ratescope.plans.registry import query
from ratescope.plans.tables import (
    EV,
    FLAGGED,
    ITEMS,
    OCC,
    ORD,
    SC,
    events,
    items,
    occurrences,
    orders,
    scores,
)


def _violations(view: str, checks: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", \'{r}\' AS rule, count(*) FILTER (WHERE {test}) AS violations FROM {view}'
        for c, r, test in checks
    )


@query(
    "check_columns",
    f"WITH {ORD} "
    + _violations(
        "ord",
        [
            ("o_orderstatus", "type", "false"),
            ("o_orderkey", "type", "true"),
            ("o_orderkey", "not_null", "o_orderkey IS NULL"),
            ("o_totalprice", "not_null", "o_totalprice IS NULL"),
            ("o_orderpriority", "domain", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')"),
            ("o_totalprice", "range", "o_totalprice < 2000 OR o_totalprice > 490000"),
            ("period", "range", "period < 1996"),
        ],
    ),
)
def check_columns(spark, folder):
    df = orders(spark, folder)
    return dq.check_rules(
        df,
        [
            dq.of_type(df, "o_orderstatus", "string"),
            dq.of_type(df, "o_orderkey", "string"),
            *dq.not_null("o_orderkey", "o_totalprice"),
            dq.in_domain("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]),
            dq.in_range("o_totalprice", 2000, 490000),
            dq.in_range("period", low=1996),
        ],
    )


@query(
    "check_invariants",
    f"WITH {OCC}, x AS (SELECT *, l_quantity - 20 AS part_a, 20 AS part_b FROM occ) "
    + _violations(
        "x",
        [
            ("l_quantity", "sum_of_parts", "l_quantity <> part_a + part_b + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END"),
            ("period", "year_of_date", "period <> year(l_shipdate)"),
            ("flag", "definition", "flag <> (l_quantity > 44)"),
            ("l_linenumber", "weekday_of_date", "l_linenumber <> isodow(l_shipdate)"),
        ],
    ),
)
def check_invariants(spark, folder):
    extra = F.when(F.col("l_linenumber") == 7, 1).otherwise(0)
    df = occurrences(spark, folder).withColumns(
        {"part_a": F.col("l_quantity") - 20, "part_b": F.lit(20)}
    )
    return dq.check_rules(
        df,
        [
            dq.equal("l_quantity", "sum_of_parts", F.col("part_a") + F.col("part_b") + extra),
            dq.equal("period", "year_of_date", F.year("l_shipdate")),
            dq.equal("flag", "definition", F.col("l_quantity") > 44),
            dq.equal("l_linenumber", "weekday_of_date", fx.iso_weekday("l_shipdate")),
        ],
    )


@query(
    "check_unique",
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicated_rows FROM g""",
)
def check_unique(spark, folder):
    return dq.check_unique(occurrences(spark, folder), ["l_orderkey", "l_linenumber"])


PROFILE = f"""min(l_shipdate) AS date_min, max(l_shipdate) AS date_max, count(*) AS rows,
  {FLAGGED} AS flagged, count(*) FILTER (WHERE NOT flag) AS unflagged,
  round({FLAGGED} / count(*), 6) AS rate,
  count(*) FILTER (WHERE l_tax = 0) AS tax_zero, count(*) FILTER (WHERE l_returnflag = 'N') AS not_returned"""
PROFILES = f"""d AS (SELECT period, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicated_rows
  FROM (SELECT period, l_orderkey, count(*) AS n FROM occ GROUP BY ALL) GROUP BY 1),
p AS (SELECT period, {PROFILE} FROM occ GROUP BY 1)"""


def _checks():
    return {"tax_zero": F.col("l_tax") == 0, "not_returned": F.col("l_returnflag") == "N"}


@query("profile_period", f"WITH {OCC}, {PROFILES} SELECT * FROM p JOIN d USING (period)")
def profile_period(spark, folder):
    return dq.profile_period(occurrences(spark, folder), "l_orderkey", "l_shipdate", _checks())


@query(
    "audit_run",
    f"""WITH {OCC}, {PROFILES} SELECT * FROM p JOIN d USING (period)
UNION ALL BY NAME SELECT NULL::INTEGER AS period, {PROFILE},
  (SELECT CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) FROM
    (SELECT count(*) AS n FROM occ GROUP BY l_orderkey)) AS duplicated_rows FROM occ""",
)
def audit_run(spark, folder):
    return dq.audit_run(occurrences(spark, folder), "l_orderkey", "l_shipdate", _checks())


GAPS = f"""{ORD}, gaps AS (SELECT o_orderkey, period, flag, o_custkey,
  nullif(o_orderpriority, '3-MEDIUM') AS priority, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 50 END AS lat,
  CASE WHEN o_custkey % 15 = 0 THEN NULL ELSE o_custkey % 40 END AS lon FROM ord)"""
GAP_COLUMNS = ["o_orderkey", "period", "flag", "o_custkey", "priority", "status", "lat", "lon"]


def gaps(spark, folder):
    """Orders with NULLs put in."""
    key = F.col("o_custkey")
    return orders(spark, folder).select(
        "o_orderkey",
        "period",
        "flag",
        "o_custkey",
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(key % 10 != 0, key % 50).alias("lat"),
        F.when(key % 15 != 0, key % 40).alias("lon"),
    )


@query(
    "null_counts",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS null_count FROM gaps'
        for c in ("priority", "status", "lat", "lon")
    ),
)
def null_counts(spark, folder):
    return dq.null_counts(gaps(spark, folder))


@query(
    "category_cardinality",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values FROM gaps'
        for c in ("period", "priority", "status", "lat")
    ),
)
def category_cardinality(spark, folder):
    return dq.category_cardinality(gaps(spark, folder), ["period", "priority", "status", "lat"])


@query(
    "distinct_tokens",
    f"WITH {ITEMS} SELECT DISTINCT trim(t) AS token FROM (SELECT unnest(string_split(tokens, ';')) AS t FROM items)",
)
def distinct_tokens(spark, folder):
    return dq.distinct_tokens(items(spark, folder), "tokens")


TYPES = {
    "o_orderkey": "bigint",
    "period": "int",
    "flag": "boolean",
    "o_custkey": "bigint",
    "priority": "string",
    "status": "string",
    "lat": "bigint",
    "lon": "bigint",
}


@query(
    "data_quality_table",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{TYPES[c]}' AS dtype, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) / count(*) * 100, 6) AS null_percent,
  count(DISTINCT {c}) AS distinct_non_null FROM gaps"""
        for c in GAP_COLUMNS
    ),
)
def data_quality_table(spark, folder):
    return dq.data_quality_table(gaps(spark, folder))


@query(
    "cardinality_table",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS distinct_non_null, count(*) - count({c}) AS null_count FROM gaps'
        for c in ("priority", "status", "o_custkey")
    ),
)
def cardinality_table(spark, folder):
    return dq.cardinality_table(gaps(spark, folder), ["priority", "status", "o_custkey"])


@query(
    "special_category_table",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{v}' AS special_category, count(*) FILTER (WHERE {c} = '{v}') AS count,
  round(count(*) FILTER (WHERE {c} = '{v}') / count(*) * 100, 6) AS percent_of_rows FROM gaps"""
        for c in ("priority", "status")
        for v in ("5-LOW", "F")
    ),
)
def special_category_table(spark, folder):
    return dq.special_category_table(gaps(spark, folder), ["priority", "status"], ["5-LOW", "F"])


@query(
    "coverage_pairs",
    f"""WITH {GAPS} SELECT 'lat_null_count' AS metric, count(*) - count(lat) AS value FROM gaps
UNION ALL SELECT 'lon_null_count', count(*) - count(lon) FROM gaps
UNION ALL SELECT 'distinct_pairs', count(*) FROM (SELECT DISTINCT lat, lon FROM gaps)""",
)
def coverage_pairs(spark, folder):
    return dq.coverage_pairs(gaps(spark, folder), "lat", "lon")


@query(
    "same_content",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'A'),
b AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus <> 'O'),
x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), y AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT true AS same_schema, (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows,
  (SELECT count(*) FROM x) AS only_left, (SELECT count(*) FROM y) AS only_right""",
)
def same_content(spark, folder):
    rows = occurrences(spark, folder)
    names = ["l_orderkey", "l_linenumber", "l_quantity"]
    return dq.same_content(
        rows.where("l_returnflag <> 'A'").select(*names),
        rows.where("l_linestatus <> 'O'").select(*names),
    )


@query(
    "dataset_fingerprint",
    f"""WITH {GAPS} SELECT count(*) AS rows, 8 AS columns, count(DISTINCT period) AS periods,
  min(period) AS first_period, max(period) AS last_period, {FLAGGED} AS flagged,
  count(DISTINCT o_orderkey) AS distinct_ids,
  4 * count(*) - count(priority) - count(status) - count(lat) - count(lon) AS null_cells FROM gaps""",
)
def dataset_fingerprint(spark, folder):
    return dq.dataset_fingerprint(gaps(spark, folder), "o_orderkey").drop("content_hash")


@query(
    "compare_groups",
    f"""WITH {GAPS}, a AS (SELECT o_orderkey, period, flag, priority, lat FROM gaps),
b AS (SELECT o_orderkey, period, flag, priority, CASE WHEN period % 3 = 0 AND o_custkey % 97 = 0 THEN NULL ELSE lat END AS lat
  FROM gaps WHERE period <> 1998),
x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT period, count(*) AS left_rows, (SELECT count(*) FROM b WHERE b.period = a.period) AS right_rows,
  period NOT IN (SELECT period FROM x) AS same FROM a GROUP BY period""",
)
def compare_groups(spark, folder):
    """Orders against a version with other NULLs in some years and one year left out."""
    names = ["o_orderkey", "period", "flag", "priority", "lat"]
    rows = gaps(spark, folder)
    lost = (F.col("period") % 3 == 0) & (F.col("o_custkey") % 97 == 0)
    other = rows.where("period <> 1998").withColumn("lat", F.when(~lost, F.col("lat")))
    return dq.compare_groups(rows.select(*names), other.select(*names), "period")


@query(
    "cardinality_sketches",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", period, count(*) AS rows, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS distinct_non_null FROM gaps GROUP BY period"""
        for c in ("priority", "status", "lat")
    ),
)
def cardinality_sketches(spark, folder):
    """Sketches of few distinct values hold them all, so their estimates are the counts."""
    sketches = dq.cardinality_sketches(gaps(spark, folder), ["priority", "status", "lat"], ["period"])
    estimate = F.hll_sketch_estimate("sketch").alias("distinct_non_null")
    return sketches.select("column", "period", "rows", "null_count", estimate)


@query("content_hash")
def content_hash(spark, folder):
    """Equal for the same rows in another order and partitioning."""
    df = gaps(spark, folder)
    moved = df.repartition(5, "status").sortWithinPartitions("lat")
    return dq.dataset_fingerprint(df, "o_orderkey").unionByName(
        dq.dataset_fingerprint(moved, "o_orderkey")
    )


@query(
    "check_periods",
    f"""WITH {ORD}, e AS (SELECT unnest([1994, 1995, 1996, 1997]) AS period), p AS (SELECT DISTINCT period FROM ord)
SELECT CAST(coalesce(e.period, p.period) AS INTEGER) AS period, e.period IS NOT NULL AS expected,
  p.period IS NOT NULL AS present FROM e FULL JOIN p ON e.period = p.period""",
)
def check_periods(spark, folder):
    return dq.check_periods(orders(spark, folder), [1994, 1995, 1996, 1997])


CAL = f"""{ORD}, cal AS (SELECT period, CASE WHEN o_custkey % 20 = 0 THEN 'no date'
  WHEN o_custkey % 21 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_text,
  CASE WHEN o_custkey % 6 = 0 THEN 'May' ELSE monthname(o_orderdate) END AS month_name FROM ord),
parsed AS (SELECT *, try_cast(day_text AS DATE) AS d FROM cal)"""


def calendar_rows(spark, folder):
    """Orders with a text date (some unreadable or NULL) and a month label (some wrong)."""
    key = F.col("o_custkey")
    return orders(spark, folder).select(
        "period",
        F.when(key % 20 == 0, "no date")
        .when(key % 21 == 0, None)
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("day_text"),
        F.when(key % 6 == 0, "May").otherwise(fx.month_name("o_orderdate")).alias("month_name"),
    )


CALENDAR_COVERAGE = """SELECT 'day_text' AS variable, period, count(day_text) AS non_null_rows,
  count(d) AS parseable_rows, count(DISTINCT d) AS distinct_values,
  CAST(count(DISTINCT month(d)) AS INTEGER) AS covered_months,
  list_aggregate(list_filter(range(1, 13), lambda m: NOT list_contains(list_distinct(list(month(d))), m)),
    'string_agg', '|') AS missing_months,
  CAST(min(d) AS VARCHAR) AS minimum_value, CAST(max(d) AS VARCHAR) AS maximum_value,
  count(*) FILTER (WHERE month_name = monthname(d)) AS consistent_rows FROM parsed GROUP BY period"""


@query(
    "calendar_coverage",
    f"WITH {CAL}, c AS ({CALENDAR_COVERAGE}) SELECT * REPLACE (coalesce(missing_months, '') AS missing_months) FROM c",
)
def calendar_coverage(spark, folder):
    label = fx.month_name(F.col("day_text").try_cast("date"))
    return dq.calendar_coverage(calendar_rows(spark, folder), "day_text", "month_name", label)


@query(
    "time_coverage",
    f"""WITH {EV}, t AS (SELECT period, hour, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE time_text END AS clock FROM ev)
SELECT 'clock' AS variable, period, count(clock) AS non_null_rows,
  count(try_cast(clock AS TIME)) AS parseable_rows, count(DISTINCT try_cast(clock AS TIME)) AS distinct_values,
  CAST(min(try_cast(clock AS TIME)) AS VARCHAR) AS minimum_value,
  CAST(max(try_cast(clock AS TIME)) AS VARCHAR) AS maximum_value,
  count(*) FILTER (WHERE hour(try_cast(clock AS TIME)) = hour) AS consistent_rows FROM t GROUP BY period""",
)
def time_coverage(spark, folder):
    clock = F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.col("time_text"))
    return dq.time_coverage(events(spark, folder).withColumn("clock", clock), "clock", "hour")


@query(
    "check_predictors",
    f"WITH {GAPS} "
    + _violations(
        "gaps",
        [
            ("priority", "not_null", "priority IS NULL"),
            ("lat", "not_null", "lat IS NULL"),
            ("lat", "binary", "lat NOT IN (0, 1)"),
            ("absent", "present", "true"),
        ],
    ),
)
def check_predictors(spark, folder):
    return dq.check_predictors(gaps(spark, folder), ["priority", "lat", "absent"], ["lat"])


PREDICTIONS = f"""{SC}, pred AS (SELECT o_orderkey, period,
  CASE WHEN o_orderkey % 50 = 0 THEN NOT flag ELSE flag END AS flag,
  CASE WHEN o_orderkey % 40 = 0 THEN score + 2 ELSE score END AS score,
  CASE WHEN o_orderkey % 30 = 0 THEN 99 ELSE fold END AS fold FROM sc WHERE period BETWEEN 1996 AND 2000),
src AS (SELECT * FROM ord WHERE o_orderpriority <> '5-LOW')"""


@query(
    "check_predictions",
    f"""WITH {PREDICTIONS}
SELECT 'score_out_of_range' AS "check", count(*) FILTER (WHERE score > 1 OR score < 0) AS violations FROM pred
UNION ALL SELECT 'wrong_fold', count(*) FILTER (WHERE fold <> period - 1995) FROM pred
UNION ALL SELECT 'duplicated_ids', 0 FROM (SELECT 1)
UNION ALL SELECT 'unknown_ids', count(*) FROM pred WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)
UNION ALL SELECT 'flag_differs', count(*) FILTER (WHERE p.flag <> s.flag) FROM pred p JOIN src s USING (o_orderkey)
UNION ALL SELECT 'period_differs', count(*) FILTER (WHERE p.period <> s.period) FROM pred p JOIN src s USING (o_orderkey)
UNION ALL SELECT 'missing_ids', count(*) FROM src WHERE o_orderkey NOT IN (SELECT o_orderkey FROM pred)
UNION ALL SELECT 'null_flag', count(*) FILTER (WHERE flag IS NULL) FROM pred
UNION ALL SELECT 'duplicated_source_ids', count(*) - count(DISTINCT o_orderkey) FROM src""",
)
def check_predictions(spark, folder):
    key = F.col("o_orderkey")
    predictions = (
        scores(spark, folder)
        .where("period BETWEEN 1996 AND 2000")
        .select(
            "o_orderkey",
            "period",
            F.when(key % 50 == 0, ~F.col("flag")).otherwise(F.col("flag")).alias("flag"),
            F.when(key % 40 == 0, F.col("score") + 2).otherwise(F.col("score")).alias("score"),
            F.when(key % 30 == 0, 99).otherwise(F.col("fold")).alias("fold"),
        )
    )
    source = orders(spark, folder).where("o_orderpriority <> '5-LOW'")
    folds = {p: p - 1995 for p in range(1996, 2001)}
    return dq.check_predictions(predictions, source, "o_orderkey", "score", folds)

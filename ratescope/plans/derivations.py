"""Derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope.operators import features, statistics
from ratescope.plans.registry import query
from ratescope.plans.tables import (
    EV,
    OCC,
    ORD,
    PLACES,
    SCD,
    events,
    items,
    occurrences,
    orders,
    places,
    scores,
)


def _n():
    return F.count(F.lit(1)).alias("n")


@query(
    "derive_flag",
    """SELECT (greatest(l_quantity - 45, 0) > 0 OR greatest(l_linenumber - 6, 0) > 0) AS severe,
  count(*) AS n FROM lineitem GROUP BY 1""",
)
def derive_flag(spark, folder):
    dead = F.greatest(F.col("l_quantity") - 45, F.lit(0))
    hurt = F.greatest(F.col("l_linenumber") - 6, F.lit(0))
    return occurrences(spark, folder).groupBy(fx.any_positive(dead, hurt).alias("severe")).agg(_n())


@query(
    "derive_calendar",
    """SELECT CAST(month(ts) AS INTEGER) AS month, monthname(ts) AS month_name,
  CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS weekday, count(*) AS n FROM events GROUP BY ALL""",
)
def derive_calendar(spark, folder):
    return (
        events(spark, folder)
        .groupBy(
            fx.month_number("ts").alias("month"),
            fx.month_name("ts").alias("month_name"),
            F.hour("ts").alias("hour"),
            fx.weekday_name("ts").alias("weekday"),
        )
        .agg(_n())
    )


@query(
    "derive_weekday_group",
    """SELECT CASE WHEN isodow(ts) <= 5 THEN 'working day' ELSE 'weekend' END AS weekday_group,
  count(*) AS n FROM events GROUP BY 1""",
)
def derive_weekday_group(spark, folder):
    group = fx.weekday_group(fx.weekday_name("ts"))
    return events(spark, folder).groupBy(group.alias("weekday_group")).agg(_n())


@query(
    "map_strict",
    f"""WITH {ORD} SELECT o_orderkey % 7 AS k, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 1
  WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END)::BIGINT AS level
FROM ord GROUP BY 1""",
)
def map_strict(spark, folder):
    levels = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
    level = fx.map_strict(levels, "o_orderpriority", "priority")
    return (
        orders(spark, folder)
        .groupBy((F.col("o_orderkey") % 7).alias("k"))
        .agg(F.sum(level).alias("level"))
    )


@query(
    "map_default",
    """SELECT CASE event_type WHEN 'error' THEN 'problem' WHEN 'purchase' THEN 'sale' ELSE 'other' END
  AS kind, count(*) AS n FROM events GROUP BY 1""",
)
def map_default(spark, folder):
    kind = fx.map_default({"error": "problem", "purchase": "sale"}, "event_type", "other")
    return events(spark, folder).groupBy(kind.alias("kind")).agg(_n())


@query(
    "label_concat",
    f"""WITH {PLACES} SELECT n_name || ' - ' || r_name AS place, count(*) AS n FROM places GROUP BY 1
UNION ALL SELECT CASE WHEN code = 0 THEN 'not identified' ELSE 'BR ' || code END, count(*)
FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) % 25 AS code FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY 1""",
)
def label_concat(spark, folder):
    named = places(spark, folder).groupBy(fx.place_label("n_name", "r_name").alias("place"))
    coded = items(spark, folder).groupBy(fx.code_label("code").alias("place"))
    return named.agg(_n()).unionByName(coded.agg(_n()))


@query(
    "text_functions",
    """WITH t AS (SELECT '  ' || event_type || ' ' AS a, replace(CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS v,
  event_type FROM events)
SELECT trim(a) AS kind, round(sum(CAST(replace(v, ',', '.') AS DOUBLE)), 2) AS total,
  CAST(sum(length(a)) AS BIGINT) AS letters FROM t GROUP BY 1""",
)
def text_functions(spark, folder):
    padded = F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))
    comma = F.regexp_replace(F.col("value").cast("decimal(12,2)").cast("string"), r"\.", ",")
    return (
        events(spark, folder)
        .select(padded.alias("a"), comma.alias("v"))
        .groupBy(fx.clean_text("a").alias("kind"))
        .agg(
            F.round(F.sum(fx.comma_decimal("v")), 2).alias("total"),
            F.sum(F.length("a")).alias("letters"),
        )
    )


@query(
    "date_functions",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(isodow(o_orderdate) AS INTEGER) AS weekday, count(*) AS n FROM orders GROUP BY ALL""",
)
def date_functions(spark, folder):
    return (
        orders(spark, folder)
        .groupBy(
            F.year("o_orderdate").alias("year"),
            fx.month_number("o_orderdate").alias("month"),
            fx.iso_weekday("o_orderdate").alias("weekday"),
        )
        .agg(_n())
    )


TIMES = """t AS (SELECT CASE WHEN event_type = 'error' THEN 'bad ' || time_text ELSE time_text END AS x,
  event_type FROM ev)"""


@query(
    "parse_time_lenient",
    f"""WITH {EV}, {TIMES} SELECT event_type, CAST(hour(try_cast(x AS TIME)) AS INTEGER) AS hour,
  CAST(sum(epoch(try_cast(x AS TIME))) AS BIGINT) AS seconds, count(*) AS n FROM t GROUP BY ALL""",
)
def parse_time_lenient(spark, folder):
    bad = F.col("event_type") == "error"
    text = F.when(bad, F.concat(F.lit("bad "), F.col("time_text"))).otherwise(F.col("time_text"))
    return (
        events(spark, folder)
        .withColumn("x", text)
        .groupBy("event_type", fx.time_hour("x").alias("hour"))
        .agg(F.sum(fx.time_of_day("x").cast("bigint")).alias("seconds"), _n())
    )


@query(
    "math_helpers",
    """SELECT l_linenumber, round(avg(1 / (1 + exp(-((l_quantity - 25) * 4))))::DOUBLE, 9) AS mean_logistic,
  round(abs(avg(l_quantity) - 25), 6) AS gap FROM lineitem GROUP BY 1""",
)
def math_helpers(spark, folder):
    return (
        occurrences(spark, folder)
        .groupBy("l_linenumber")
        .agg(
            F.round(F.avg(fx.stable_logistic((F.col("l_quantity") - 25) * 4)), 9).alias(
                "mean_logistic"
            ),
            fx.point_gap(F.avg("l_quantity"), F.lit(25.0)).alias("gap"),
        )
    )


@query(
    "outcome_label",
    f"""WITH {SCD} SELECT CASE WHEN flag AND decision THEN 'TP' WHEN decision THEN 'FP'
  WHEN flag THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM scd GROUP BY 1""",
)
def outcome_label(spark, folder):
    return (
        scores(spark, folder)
        .groupBy(fx.outcome_label("flag", "decision").alias("outcome"))
        .agg(_n())
    )


@query(
    "apply_threshold",
    f"""WITH {SCD} SELECT period, score >= CAST(0.5 AS DOUBLE) AS decision, count(*) AS n FROM sc GROUP BY ALL""",
)
def apply_threshold(spark, folder):
    return (
        scores(spark, folder)
        .groupBy("period", fx.at_least("score", 0.5).alias("decision"))
        .agg(_n())
    )


@query(
    "finite_range",
    f"""WITH x AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 7 = 0
  THEN 'inf'::DOUBLE ELSE o_totalprice / 400000 END AS v FROM orders)
SELECT isfinite(v) AS finite, (isfinite(v) AND v BETWEEN 0 AND 1) AS in_unit, count(*) AS n
FROM x GROUP BY ALL""",
)
def finite_range(spark, folder):
    key = F.col("o_orderkey")
    value = (
        F.when(key % 5 == 0, float("nan"))
        .when(key % 7 == 0, float("inf"))
        .otherwise(F.col("o_totalprice") / 400000)
    )
    return (
        orders(spark, folder)
        .withColumn("v", value)
        .groupBy(fx.is_finite("v").alias("finite"), fx.in_unit_interval("v").alias("in_unit"))
        .agg(_n())
    )


@query(
    "project_roles",
    f"""WITH {ORD} SELECT o_orderkey, period, flag, o_orderstatus, o_orderpriority FROM ord""",
)
def project_roles(spark, folder):
    roles = features.Roles(
        ("o_orderkey", "period"), "flag", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",)
    )
    return features.project_roles(orders(spark, folder), roles)


@query(
    "cumulative_scores",
    f"""WITH {OCC}, g AS (SELECT l_extendedprice AS value, count(*) AS n FROM occ GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY value DESC) AS cum FROM g)
SELECT CAST(count(*) AS BIGINT) AS cells, CAST(sum(cum) AS BIGINT) AS checksum, max(cum)::BIGINT AS last FROM c""",
)
def cumulative_scores(spark, folder):
    """Running totals over every distinct price, cut into ranges of 5,000 values."""
    cells = statistics.frequency_cells(occurrences(spark, folder), ["l_extendedprice"])
    run = statistics.running_totals(
        statistics.settle(cells), "value", ["n"], descending=True, rows_per_range=5_000
    )
    return run.agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("cum_n").alias("checksum"),
        F.max("cum_n").alias("last"),
    )

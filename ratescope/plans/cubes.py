"""Cubes, facets, set operations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope.functions import selection
from ratescope.operators import cubes, joins, rates
from ratescope.plans.registry import query
from ratescope.plans.tables import (
    FLAGGED,
    OCC,
    ORD,
    PLACES,
    SC,
    events,
    occurrences,
    orders,
    places,
    scores,
)

COUNTS = f"""count(*) AS total, {FLAGGED} AS flagged, count(*) FILTER (WHERE NOT flag) AS unflagged,
  round({FLAGGED} / count(*), 9) AS proportion"""
DIMENSIONS = ["period", "l_returnflag", "l_linestatus"]


def _rounded(df):
    return df.withColumn("proportion", F.round("proportion", 9))


@query("cube", f"WITH {OCC} SELECT period, l_returnflag, l_linestatus, {COUNTS} FROM occ GROUP BY ALL")
def cube(spark, folder):
    return _rounded(cubes.cube(occurrences(spark, folder), DIMENSIONS))


@query(
    "cubes_one_scan",
    f"""WITH {OCC}
SELECT 'time' AS cube, period, l_returnflag, NULL::VARCHAR AS l_linestatus, NULL::INTEGER AS l_linenumber,
  {COUNTS} FROM occ GROUP BY ALL
UNION ALL SELECT 'state', period, NULL, l_linestatus, NULL, {COUNTS} FROM occ GROUP BY period, l_linestatus
UNION ALL SELECT 'line', period, NULL, NULL, l_linenumber, {COUNTS} FROM occ GROUP BY period, l_linenumber""",
)
def cubes_one_scan(spark, folder):
    sets = {
        "time": ["period", "l_returnflag"],
        "state": ["period", "l_linestatus"],
        "line": ["period", "l_linenumber"],
    }
    return _rounded(cubes.cubes(occurrences(spark, folder), sets))


ROLLED = """CAST(sum(total) AS BIGINT) AS total, CAST(sum(flagged) AS BIGINT) AS flagged,
  CAST(sum(unflagged) AS BIGINT) AS unflagged, round(sum(flagged) / sum(total), 9) AS proportion"""
CUBE = f"c AS (SELECT period, l_returnflag, l_linestatus, {COUNTS} FROM occ GROUP BY ALL)"


@query(
    "roll_up_cube",
    f"""WITH {OCC}, {CUBE} SELECT l_returnflag, {ROLLED} FROM c
WHERE period IN (1996, 1997) AND l_linestatus IN ('O') GROUP BY l_returnflag""",
)
def roll_up_cube(spark, folder):
    cells = cubes.cube(occurrences(spark, folder), DIMENSIONS)
    filters = {"period": [1996, 1997], "l_linestatus": ["O"], "l_returnflag": []}
    return _rounded(cubes.roll_up_cube(cells, "l_returnflag", filters))


@query(
    "select_or_all",
    f"""WITH {OCC} SELECT l_linestatus, count(*) AS n FROM occ
WHERE l_returnflag IN ('A', 'R') GROUP BY 1""",
)
def select_or_all(spark, folder):
    chosen = selection({"l_returnflag": ["A", "R"], "l_linestatus": []})
    return occurrences(spark, folder).where(chosen).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "facet_values",
    f"""WITH {OCC} SELECT DISTINCT 'period' AS dimension, CAST(period AS VARCHAR) AS value FROM occ
UNION ALL SELECT DISTINCT 'l_returnflag', l_returnflag FROM occ
UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM occ""",
)
def facet_values(spark, folder):
    return cubes.facet_values(cubes.cube(occurrences(spark, folder), DIMENSIONS), DIMENSIONS)


@query("dependent_facets", f"WITH {PLACES} SELECT DISTINCT r_name, n_name FROM places")
def dependent_facets(spark, folder):
    cells = cubes.cube(places(spark, folder), ["period", "r_name", "n_name"])
    return cubes.dependent_facets(cells, "r_name", "n_name")


@query("sort_cube", f"WITH {ORD} SELECT o_orderpriority, period, {COUNTS} FROM ord GROUP BY ALL")
def sort_cube(spark, folder):
    cells = _rounded(cubes.cube(orders(spark, folder), ["o_orderpriority", "period"]))
    order = {"o_orderpriority": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]}
    return cubes.sort_cube(cells, ["o_orderpriority", "period"], order)


@query(
    "reconcile_tables",
    f"""WITH {OCC}, a AS (SELECT period, count(*) AS total, {FLAGGED} AS flagged FROM occ GROUP BY 1),
b AS (SELECT period, count(*) AS total, {FLAGGED} AS flagged FROM occ WHERE l_linenumber <> 7 OR period <> 1998 GROUP BY 1),
x AS (SELECT period, 'total' AS metric, total AS v FROM a UNION ALL SELECT period, 'flagged', flagged FROM a),
y AS (SELECT period, 'total' AS metric, total AS v FROM b UNION ALL SELECT period, 'flagged', flagged FROM b)
SELECT x.period, x.metric, CAST(x.v AS VARCHAR) AS expected_value, CAST(y.v AS VARCHAR) AS exported_value,
  CASE WHEN x.v = y.v THEN 'PASS' ELSE 'FAIL' END AS status
FROM x FULL JOIN y ON x.period = y.period AND x.metric = y.metric""",
)
def reconcile_tables(spark, folder):
    occ = occurrences(spark, folder)
    expected = rates.period_summary(occ)
    partial = occ.where("l_linenumber <> 7 OR period <> 1998")
    exported = cubes.roll_up_cube(cubes.cube(partial, DIMENSIONS), "period")
    return cubes.reconcile_tables(expected, exported, ["period"], ["total", "flagged"])


# --- joins -----------------------------------------------------------------------------------


@query(
    "checked_join",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def checked_join(spark, folder):
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    joined = joins.checked_join(
        orders(spark, folder).select(F.col("o_custkey").alias("key"), "o_totalprice"),
        customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")),
        ["key"],
    )
    named = nation.select(F.col("n_nationkey").alias("nation"), "n_name")
    return (
        joins.checked_join(joined, named, ["nation"])
        .groupBy("n_name")
        .agg(
            F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price")
        )
    )


@query(
    "anti_join_both",
    """WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <> '5-LOW'),
m AS (SELECT 'right' AS missing_from, k FROM a WHERE k NOT IN (SELECT k FROM b)
  UNION ALL SELECT 'left', k FROM b WHERE k NOT IN (SELECT k FROM a))
SELECT missing_from, count(*) AS keys, CAST(sum(k) AS BIGINT) AS key_sum FROM m GROUP BY 1""",
)
def anti_join_both(spark, folder):
    base = orders(spark, folder)
    missing = joins.missing_keys(
        base.where("o_orderstatus <> 'P'"), base.where("o_orderpriority <> '5-LOW'"), ["o_orderkey"]
    )
    return missing.groupBy("missing_from").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("o_orderkey").alias("key_sum")
    )


@query(
    "align_tables",
    f"""WITH {SC}, a AS (SELECT o_orderkey, period, flag FROM ord WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey, period, (flag OR o_orderpriority = '5-LOW') AS flag FROM ord WHERE period < 2001)
SELECT count(*) FILTER (WHERE b.o_orderkey IS NULL) AS missing_from_right,
  count(*) FILTER (WHERE a.o_orderkey IS NULL) AS missing_from_left,
  count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey) AS matched,
  count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey AND a.period <> b.period) AS period_mismatches,
  count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey AND a.flag <> b.flag) AS flag_mismatches
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def align_tables(spark, folder):
    base = orders(spark, folder)
    left = base.where("o_orderstatus <> 'P'")
    raised = F.col("flag") | (F.col("o_orderpriority") == "5-LOW")
    right = base.where("period < 2001").withColumn("flag", raised)
    return joins.alignment_report(left, right, ["o_orderkey"], ["period", "flag"])


@query(
    "aligned_scores",
    f"""WITH {SC} SELECT period, count(*) AS n, round(avg(score), 9) AS mean_score FROM sc GROUP BY 1""",
)
def aligned_scores(spark, folder):
    source = orders(spark, folder).select("o_orderkey", "period", "flag", "o_orderstatus")
    predictions = scores(spark, folder).select("o_orderkey", "period", "flag", "score")
    aligned = joins.align_tables(source, predictions, ["o_orderkey"], ["period", "flag"])
    return aligned.groupBy("period").agg(
        F.count("o_orderkey").alias("n"), F.round(F.avg("score"), 9).alias("mean_score")
    )


# --- set operations --------------------------------------------------------------------------


@query(
    "union_strict",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS n FROM orders
WHERE year(o_orderdate) IN (1995, 1997, 2001) GROUP BY 1""",
)
def union_strict(spark, folder):
    base = orders(spark, folder).select("o_orderkey", "period")
    stacked = joins.union_strict([base.where(F.col("period") == p) for p in (1995, 1997, 2001)])
    return stacked.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_relaxed",
    """SELECT 'orders' AS source, o_orderstatus AS status, NULL::VARCHAR AS kind, count(*) AS n
FROM orders GROUP BY ALL
UNION ALL SELECT 'events', NULL, event_type, count(*) FROM events GROUP BY ALL""",
)
def union_relaxed(spark, folder):
    a = orders(spark, folder).select(
        F.lit("orders").alias("source"), F.col("o_orderstatus").alias("status")
    )
    b = events(spark, folder).select(
        F.lit("events").alias("source"), F.col("event_type").alias("kind")
    )
    return joins.union_relaxed([a, b]).groupBy("source", "status", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "category_set_operations",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1),
b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09 AND l_linenumber = 2)
SELECT k AS l_suppkey, CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN 'both'
  WHEN k IN (SELECT k FROM a) THEN 'left' ELSE 'right' END AS presence
FROM (SELECT k FROM a UNION SELECT k FROM b)""",
)
def category_set_operations(spark, folder):
    occ = occurrences(spark, folder)
    return joins.set_presence(
        occ.where("l_quantity > 49 AND l_linenumber = 1"),
        occ.where("l_discount > 0.09 AND l_linenumber = 2"),
        "l_suppkey",
    )


@query(
    "distinct_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 1""",
)
def distinct_first(spark, folder):
    rows = occurrences(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return joins.distinct_on(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])

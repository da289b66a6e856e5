"""Occurrence, place, token, event and score views over the sales tables, in Spark and in SQL.

``period`` is an integer, ``flag`` a boolean. Development is 1995–2000, the final period 2001.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEVELOPMENT = [1995, 1996, 1997, 1998, 1999, 2000]
FINAL = 2001
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NAME_TOKENS = [
    "anvil",
    "blue",
    "bolt",
    "cold",
    "gear",
    "gizmo",
    "hot",
    "large",
    "new",
    "old",
    "plate",
    "red",
    "ring",
    "rod",
    "small",
    "widget",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Line items; the id is not unique."""
    return table(spark, folder, "lineitem").withColumns(
        {
            "period": F.year("l_shipdate"),
            "flag": (F.col("l_quantity") > 45) | (F.col("l_discount") >= 0.09),
        }
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a unique id."""
    return table(spark, folder, "orders").withColumns(
        {"period": F.year("o_orderdate"), "flag": F.col("o_totalprice") > 350000}
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one month; the period is the week."""
    return table(spark, folder, "events").withColumns(
        {
            "period": F.floor((F.day("ts") - 1) / 7).cast("int") + 1,
            "flag": F.col("value") > 60,
            "time_text": F.date_format("ts", "HH:mm:ss"),
            "date_text": F.date_format("ts", "yyyy-MM-dd"),
            "hour": F.hour("ts"),
        }
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nation (state), region (macro-region) and market segment."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        orders(spark, folder)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a multi-valued name field (one token repeated) and a road-like code."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    name = F.split("p_name", " ")
    return occurrences(spark, folder).join(
        part.select(
            "p_partkey",
            F.concat_ws(";", name[0], F.concat(F.lit(" "), name[1]), name[0]).alias("tokens"),
            (F.substring("p_brand", 7, 3).cast("int") % 25).alias("code"),
        ),
        F.col("l_partkey") == F.col("p_partkey"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a score that has many ties, a fold for 1996–2000 and a decision at 0.45."""
    raised = F.when(F.col("flag"), 200).otherwise(0)
    score = ((F.col("o_orderkey") * 37) % 701 + raised).cast("double") / F.lit(1000.0)
    return orders(spark, folder).select(
        "o_orderkey",
        "period",
        "flag",
        score.alias("score"),
        (F.col("period") - 1995).alias("fold"),
        (score >= 0.45).alias("decision"),
    )


# --- the same views in SQL -------------------------------------------------------------------

OCC = """occ AS (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS period,
  (l_quantity > 45 OR l_discount >= CAST(0.09 AS DOUBLE)) AS flag FROM lineitem)"""
ORD = """ord AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS period,
  o_totalprice > 350000 AS flag FROM orders)"""
EV = """ev AS (SELECT *, CAST((day(ts) - 1) // 7 + 1 AS INTEGER) AS period, value > 60 AS flag,
  strftime(ts, '%H:%M:%S') AS time_text, strftime(ts, '%Y-%m-%d') AS date_text,
  CAST(hour(ts) AS INTEGER) AS hour FROM events)"""
PLACES = f"""{ORD}, places AS (SELECT * FROM ord JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ITEMS = f"""{OCC}, items AS (SELECT occ.*,
  split_part(p_name, ' ', 1) || '; ' || split_part(p_name, ' ', 2) || ';'
    || split_part(p_name, ' ', 1) AS tokens,
  CAST(substr(p_brand, 7) AS INTEGER) % 25 AS code
  FROM occ JOIN part ON l_partkey = p_partkey)"""
TOK = f"""{ITEMS}, split AS (SELECT period, flag, row_number() OVER () AS row_id,
  unnest(string_split(tokens, ';')) AS t FROM items),
tok AS (SELECT period, flag, row_id, trim(t) AS token FROM split GROUP BY ALL)"""
SC = f"""{ORD}, sc AS (SELECT o_orderkey, period, flag,
  CAST((o_orderkey * 37) % 701 + CASE WHEN flag THEN 200 ELSE 0 END AS DOUBLE)
    / CAST(1000 AS DOUBLE) AS score, period - 1995 AS fold FROM ord)"""
SCD = f"{SC}, scd AS (SELECT *, score >= CAST(0.45 AS DOUBLE) AS decision FROM sc)"

FLAGGED = "count(*) FILTER (WHERE flag)"
MEASURES = f"""count(*) AS total, {FLAGGED} AS flagged, count(*) FILTER (WHERE NOT flag) AS unflagged,
  round({FLAGGED} / count(*) * 100, 6) AS rate_percent"""


def summary_sql(view: str, keys: str, share: str | None = "share_percent") -> str:
    extra = "" if share is None else (
        f", round(count(*) / (SELECT count(*) FROM {view}) * 100, 6) AS {share}"
    )
    return f"SELECT {keys}, {MEASURES}{extra} FROM {view} GROUP BY {keys}"

"""Reading and writing: each query writes rows derived from the tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratescope.operators.cubes import cube
from ratescope.operators.rates import rate_summary
from ratescope.plans.registry import query
from ratescope.plans.tables import FLAGGED, OCC, ORD, events, occurrences, orders, summary_sql
from ratescope.runtime import scratch_path
from ratescope.sources import (
    read_columnar,
    read_delimited_strict,
    read_periods,
    scan_columns,
    scan_period,
    standardize_types,
    write_columnar,
    write_cube_json,
    write_table,
)

COLUMNS = ["id", "day", "clock", "kind", "road", "value", "dead", "hurt"]


def _raw(spark, folder):
    """Events as the text a delimited file would hold."""
    key = F.col("event_id")
    return events(spark, folder).select(
        key.cast("string").alias("id"),
        F.col("date_text").alias("day"),
        F.col("time_text").alias("clock"),
        F.when(key % 11 == 0, "N/A")
        .otherwise(F.concat(F.lit("preço – "), F.col("event_type")))
        .alias("kind"),
        F.when(key % 7 == 0, "none").otherwise((key % 90).cast("string")).alias("road"),
        F.regexp_replace(F.col("value").cast("decimal(12,2)").cast("string"), r"\.", ",").alias(
            "value"
        ),
        (key % 5 % 2).cast("string").alias("dead"),
        (key % 3 % 2).cast("string").alias("hurt"),
    )


def _write_text(df, path, encoding="windows-1252", period=None):
    writer = df.write.option("sep", ";").option("header", True).option("encoding", encoding)
    if period is not None:
        writer = writer.partitionBy(period)
    writer.csv(path)


def _code_pages(spark):
    """The queries own their session, so they may allow Windows code pages."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


RAW = """raw AS (SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS day,
  strftime(ts, '%H:%M:%S') AS clock,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'preço – ' || event_type END AS kind,
  CASE WHEN event_id % 7 = 0 THEN 'none' ELSE CAST(event_id % 90 AS VARCHAR) END AS road,
  replace(CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS value,
  CAST(event_id % 5 % 2 AS VARCHAR) AS dead, CAST(event_id % 3 % 2 AS VARCHAR) AS hurt FROM events)"""
TYPED = f"""{RAW}, typed AS (SELECT id, CAST(day AS DATE) AS day, clock, kind, try_cast(road AS BIGINT) AS road,
  CAST(replace(value, ',', '.') AS DOUBLE) AS value, CAST(dead AS BIGINT) AS dead, CAST(hurt AS BIGINT) AS hurt,
  CAST(2024 AS INTEGER) AS period, (dead <> '0' OR hurt <> '0') AS flag FROM raw)"""
TYPES = {
    "text": ["kind"],
    "dates": ["day"],
    "times": ["clock"],
    "integers": ["dead", "hurt"],
    "lenient_integers": ["road"],
    "decimals": ["value"],
    "flag_counts": ["dead", "hurt"],
}


@query("read_delimited_strict", f"WITH {RAW} SELECT * FROM raw")
def read_strict(spark, folder):
    _code_pages(spark)
    path = scratch_path(spark, "raw")
    _write_text(_raw(spark, folder), path)
    return read_delimited_strict(spark, path, COLUMNS)


@query("standardize_types", f"WITH {TYPED} SELECT * FROM typed")
def standardize(spark, folder):
    return standardize_types(_raw(spark, folder).replace("N/A", None, ["kind"]), 2024, **TYPES)


@query(
    "load_periods",
    f"""WITH {TYPED} SELECT CAST(CAST(id AS BIGINT) % 4 + 2021 AS INTEGER) AS period, count(*) AS rows,
  count(kind) AS kinds, count(road) AS roads, round(sum(value), 2) AS value, count(*) FILTER (WHERE flag) AS flagged,
  min(day) AS first_day, max(clock) AS last_clock FROM typed GROUP BY 1""",
)
def load_periods(spark, folder):
    _code_pages(spark)
    path = scratch_path(spark, "periods")
    raw = _raw(spark, folder).withColumn("year", F.col("id").cast("bigint") % 4 + 2021)
    _write_text(raw, path, period="year")
    files = {year: f"{path}/year={year}" for year in range(2021, 2025)}
    return (
        read_periods(spark, files, COLUMNS, **TYPES)
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("kind").alias("kinds"),
            F.count("road").alias("roads"),
            F.round(F.sum("value"), 2).alias("value"),
            F.count_if("flag").alias("flagged"),
            F.min("day").alias("first_day"),
            F.max("clock").alias("last_clock"),
        )
    )


def _stored(spark, folder):
    path = scratch_path(spark, "orders")
    write_columnar(orders(spark, folder), path, "period")
    return path


@query("write_columnar", f"WITH {ORD} SELECT o_orderkey, period, flag, o_orderpriority FROM ord")
def columnar(spark, folder):
    columns = ["o_orderkey", "period", "flag", "o_orderpriority"]
    return read_columnar(spark, _stored(spark, folder), columns)


@query("scan_period", f"WITH {ORD} SELECT o_orderkey, flag, period FROM ord WHERE period IN (1996, 1999)")
def scan_some_periods(spark, folder):
    path = _stored(spark, folder)
    return scan_period(spark, path, [1996, 1999], ["o_orderkey", "flag", "period"])


@query("scan_columns", f"WITH {ORD} SELECT period, o_orderstatus, count(*) AS n FROM ord GROUP BY ALL")
def scan_some_columns(spark, folder):
    path = _stored(spark, folder)
    narrow = scan_columns(spark, path, ["period", "o_orderstatus"])
    return narrow.groupBy("period", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("write_table", f"WITH {OCC} {summary_sql('occ', 'l_suppkey')}")
def table_csv(spark, folder):
    summary = rate_summary(occurrences(spark, folder), "l_suppkey")
    path = scratch_path(spark, "summary")
    write_table(summary, path)
    return spark.read.schema(summary.schema).option("header", True).csv(path)


@query(
    "write_cube_json",
    f"""WITH {OCC} SELECT period, l_returnflag, count(*) AS total, {FLAGGED} AS flagged,
  count(*) FILTER (WHERE NOT flag) AS unflagged, {FLAGGED} / count(*) AS proportion FROM occ GROUP BY ALL""",
)
def cube_json(spark, folder):
    cells = cube(occurrences(spark, folder), ["period", "l_returnflag"])
    path = scratch_path(spark, "cube")
    write_cube_json(cells, path)
    return spark.read.schema(cells.schema).json(path)

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ratescope import functions as fx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(
        column.alias("y")
    ).first()["y"]


@pytest.mark.parametrize("dead,hurt,flag", [(0, 0, False), (1, 0, True), (0, 1, True)])
def test_any_positive(spark, dead, hurt, flag):
    assert one(spark, fx.any_positive("dead", "hurt"), dead=dead, hurt=hurt) is flag


def test_strict_map_rejects_unknown_and_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    mapped = df.select(fx.map_strict({"a": 1}, "k").alias("v"))
    assert [r["v"] for r in mapped.collect()] == [1, None]
    with pytest.raises(Exception, match="unmapped"):
        df.select(fx.map_strict({"b": 1}, "k")).collect()


def test_large_mapping_is_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        fx.map_default({i: i for i in range(2_000)}, "k", 0)


def test_map_default(spark):
    assert one(spark, fx.map_default({"a": 1}, "k", 9), k="z") == 9


def test_stable_logistic_at_extremes(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,), (1.5,)], ["m"])
    got = [r[0] for r in df.select(fx.stable_logistic("m")).collect()]
    assert got[:3] == [0.0, 0.5, 1.0]
    assert got[3] == pytest.approx(1 / (1 + math.exp(-1.5)))


@pytest.mark.parametrize("text,value", [(" 12,5 ", 12.5), ("x", None), ("", None), ("-3", -3.0)])
def test_comma_decimal(spark, text, value):
    assert one(spark, fx.comma_decimal("t"), t=text) == value


def test_tokens_are_trimmed_and_distinct(spark):
    assert one(spark, fx.token_array("t"), t="Reta; Reta ;Curva") == ["Reta", "Curva"]


def test_bin_edge_rules(spark):
    edges = F.array(F.lit(1.0), F.lit(2.0))
    for value, at_or_below, below in ((0.5, 0, 0), (1.0, 1, 0), (2.0, 2, 1), (9.0, 2, 2)):
        assert one(spark, fx.count_at_or_below(edges, F.col("v")), v=value) == at_or_below
        assert one(spark, fx.count_below(edges, F.col("v")), v=value) == below


def test_threshold_is_inclusive(spark):
    assert one(spark, fx.at_least("p", 0.5), p=0.5) is True


def test_selection_without_values_keeps_all(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], ["k", "v"])
    assert df.where(fx.selection({"k": [], "v": []})).count() == 2
    assert df.where(fx.selection({"k": ["a"], "v": []})).count() == 1


def test_iso_weekday_and_names(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS monday, DATE'2024-01-07' AS sunday")
    row = df.select(
        fx.iso_weekday("monday"), fx.iso_weekday("sunday"), fx.weekday_name("sunday")
    ).first()
    assert tuple(row) == (1, 7, "Sunday")


def test_unit_interval_rejects_nan_and_infinity(spark):
    values = [0.0, 1.0, 1.1, -0.1, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = [r[0] for r in df.select(fx.in_unit_interval("p")).collect()]
    assert got == [True, True, False, False, False, False, False]

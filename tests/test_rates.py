from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ratescope.operators import cubes, lifecycle, ranking, rates, report, tokens

SCHEMA = "period int, kind string, flag boolean"
ROWS = [
    (2021, "a", True),
    (2021, "a", False),
    (2021, "b", False),
    (2022, "a", True),
    (2022, "c", True),
    (2022, "a", True),
    (2022, "a", False),
    (2023, "a", False),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_summary_counts_and_shares(df, rows):
    got = rows(rates.rate_summary(df, "kind"), "kind", "total", "flagged", "unflagged", "rate_percent", "share_percent")
    assert got == [("a", 6, 3, 3, 50.0, 75.0), ("b", 1, 0, 1, 0.0, 12.5), ("c", 1, 1, 0, 100.0, 12.5)]


def test_null_category_fails(spark):
    df = spark.createDataFrame([(2021, None, True)], SCHEMA)
    with pytest.raises(Exception, match="kind is NULL"):
        rates.rate_summary(df, "kind").collect()
    made = (
        rates.rate_summary(df, "kind").select("total"),
        rates.rate_by_period(df, "kind").groupBy().count(),
        rates.rate_with_stability(df, "kind").select("total"),
        cubes.roll_up_cube(cubes.cube(df, ["period", "kind"]), "period"),
        cubes.facet_values(cubes.cube(df, ["period", "kind"]), ["period"]),
    )
    for unread in made:
        with pytest.raises(Exception, match="kind is NULL"):
            unread.collect()


def test_null_flag_is_unflagged(spark, rows):
    df = spark.createDataFrame([(2021, "a", None), (2021, "a", True)], SCHEMA)
    assert rows(rates.rate_summary(df, "kind"), "total", "flagged", "unflagged") == [(2, 1, 1)]


def test_order_is_kept_and_unknown_fails(df):
    ordered = rates.rate_summary(df, "kind", order=["c", "a", "b"])
    assert [r["kind"] for r in ordered.collect()] == ["c", "a", "b"]
    with pytest.raises(Exception, match="unmapped"):
        rates.rate_summary(df, "kind", order=["a", "b"]).collect()


def test_first_period_has_no_change(df):
    got = [(r["period"], r["total"], r["change_percent"]) for r in rates.period_summary(df).collect()]
    assert got == [(2021, 3, None), (2022, 4, 33.333333), (2023, 1, -75.0)]


def test_weighted_rate_differs_from_mean(df):
    row = rates.rate_range(rates.period_summary(df)).first()
    assert row["weighted_rate_percent"] == 50.0
    assert row["mean_rate_percent"] == pytest.approx((100 / 3 + 75 + 0) / 3, abs=1e-6)
    assert row["range_points"] == 75.0


def test_period_shares_add_up(df):
    shares = rates.rate_by_period(df, "kind", with_share=True).groupBy("period").agg(
        F.round(F.sum("period_share_percent"), 4).alias("s")
    )
    assert {r["s"] for r in shares.collect()} == {100.0}


def test_period_without_category(df, rows):
    assert rows(rates.rate_by_period(df, []), "period", "total") == [(2021, 3), (2022, 4), (2023, 1)]


def test_leap_days_are_counted(spark, rows):
    periods = spark.createDataFrame([(2023,), (2024,), (2024,)], "period int")
    days = dict(rows(rates.calendar_days(periods), "month", "calendar_days"))
    assert days[2] == 57 and days[1] == 62 and sum(days.values()) == 731


def test_lifecycle(df, rows):
    got = {r["category"]: r for r in lifecycle.category_lifecycle(df, {"kind": "kind"}).collect()}
    assert got["a"]["present_all_periods"] and not got["a"]["only_one_period"]
    assert got["b"]["disappears_earlier"] and not got["b"]["appears_later"]
    assert got["c"]["appears_later"] and got["c"]["only_one_period"]


def test_stability_needs_three_periods(df, rows):
    got = rows(
        lifecycle.stability_filtered(df, {"kind": "kind"}, minimum_rows=6),
        "category", "periods_observed", "total", "range_points", "priority",
    )
    assert got == [("a", 3, 6, 66.666667, True)]


def test_ranking_obeys_minimum_and_exclusion(df):
    summary = rates.rate_summary(df, "kind")
    assert [r["kind"] for r in ranking.top_by_rate(summary, "kind", 2).collect()] == ["a"]
    by_volume = ranking.top_by_volume(summary, "kind", 2, {"kind": ["a"]})
    assert [r["kind"] for r in by_volume.collect()] == ["b", "c"]


def test_rate_extreme_breaks_ties_by_name(spark):
    summary = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0), ("d", 1.0)], "k string, rate_percent double")
    row = ranking.rate_extreme(summary, "k").first()
    assert (row["highest_category"], row["lowest_category"]) == ("a", "c")


def test_results_do_not_depend_on_partitioning(df, rows):
    for n in (1, 3, 7):
        moved = df.repartition(n)
        assert rows(rates.rate_summary(moved, "kind")) == rows(rates.rate_summary(df, "kind"))
        assert rows(cubes.cube(moved, ["period", "kind"])) == rows(cubes.cube(df, ["period", "kind"]))


def test_one_category_with_most_rows(spark, rows):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5_000)).alias("kind"),
        (F.col("id") % 7 == 0).alias("flag"),
        F.lit(1).alias("period"),
    )
    summary = rates.rate_summary(df, "kind")
    hot = summary.where("kind = 'hot'").first()
    assert hot["total"] == 10_000 and hot["share_percent"] == 33.333333
    assert summary.agg(F.sum("total")).first()[0] == 30_000


# --- plans -----------------------------------------------------------------------------------


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "make",
    [
        lambda df: rates.rate_summary(df, "kind"),
        lambda df: rates.rate_by_period(df, "kind", with_share=True),
        lambda df: rates.period_summary(df),
    ],
)
def test_totals_reuse_the_shuffled_cells(df, make):
    assert "ReusedExchange" in final_plan(make(df.repartition(2, "kind")))


# --- multi-valued fields ---------------------------------------------------------------------

LAYOUT = [
    (2021, "Reta;Reta; Curva", True),
    (2021, "Reta", False),
    (2022, "Curva;Ponte", False),
]


@pytest.fixture
def layout(spark):
    return spark.createDataFrame(LAYOUT, "period int, layout string, flag boolean")


def test_repeated_token_counts_once_and_shares_exceed_all(layout, rows):
    got = rows(tokens.token_rate_summary(layout, "layout"), "token", "total", "containing_percent")
    assert got == [("Curva", 2, 66.666667), ("Ponte", 1, 33.333333), ("Reta", 2, 66.666667)]


def test_unknown_token_fails(layout):
    with pytest.raises(Exception, match="unmapped token"):
        tokens.explode_tokens(layout, "layout", [], ["Reta", "Curva"]).collect()
    with pytest.raises(Exception, match="unmapped token"):
        tokens.explode_tokens(layout, "layout", ["period"], ["Reta", "Curva"]).select("period").collect()
    empty = layout.withColumn("layout", F.lit(None).cast("string"))
    for made in (tokens.explode_tokens, tokens.token_cells):
        with pytest.raises(Exception, match="unmapped token: NULL"):
            made(empty, "layout", ["period"], known=["Reta"]).groupBy().count().collect()


def test_indicators_without_join(layout, rows):
    wide = tokens.token_indicators(layout, "layout", {"Curva": "curve", "Ponte": "bridge"})
    assert rows(wide, "layout", "curve", "bridge") == [
        ("Curva;Ponte", 1, 1), ("Reta", 0, 0), ("Reta;Reta; Curva", 1, 0),
    ]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


# --- cubes -----------------------------------------------------------------------------------


def test_cube_holds_observed_cells_only(df, rows):
    cells = cubes.cube(df, ["period", "kind"])
    assert cells.count() == 5
    assert rows(cells.where("kind = 'c'"), "total", "flagged", "unflagged", "proportion") == [(1, 1, 0, 1.0)]


def test_cube_rejects_null(spark):
    df = spark.createDataFrame([(2021, None, True)], SCHEMA)
    with pytest.raises(Exception, match="kind is NULL"):
        cubes.cube(df, ["kind"]).collect()
    df = spark.createDataFrame([(2021, "a", None)], SCHEMA)
    with pytest.raises(Exception, match="flag is NULL"):
        cubes.cube(df, ["kind"]).collect()


def test_rolled_up_proportion_comes_from_sums(df, rows):
    cells = cubes.cube(df, ["period", "kind"])
    got = rows(cubes.roll_up_cube(cells, "kind", {"period": [2021, 2022]}), "kind", "total", "proportion")
    assert got == [("a", 5, 0.6), ("b", 1, 0.0), ("c", 1, 1.0)]


def test_cubes_from_one_scan_equal_single_cubes(df, rows):
    both = cubes.cubes(df, {"p": ["period"], "pk": ["period", "kind"]})
    assert rows(both.where("cube = 'p'"), "period", "total") == rows(cubes.cube(df, ["period"]), "period", "total")
    assert rows(both.where("cube = 'pk'"), "period", "kind", "flagged") == rows(
        cubes.cube(df, ["period", "kind"]), "period", "kind", "flagged"
    )


def test_sort_cube_puts_numbers_before_text(spark):
    df = spark.createDataFrame([("b",), ("10",), ("9",), ("A",)], ["k"])
    assert [r["k"] for r in cubes.sort_cube(df, ["k"]).collect()] == ["9", "10", "A", "b"]
    ordered = cubes.sort_cube(df, ["k"], {"k": ["b", "9"]})
    assert [r["k"] for r in ordered.collect()][:2] == ["b", "9"]


def test_reconciliation_finds_the_difference(df, rows):
    a = rates.period_summary(df)
    b = rates.period_summary(df.where("kind <> 'c'"))
    checks = cubes.reconcile_tables(a, b, ["period"], ["total"])
    assert rows(checks, "period", "status") == [(2021, "PASS"), (2022, "FAIL"), (2023, "PASS")]


def test_population_table_has_a_total_row(df, rows):
    total = report.population_table(df).where("scope = 'total'").first()
    assert (total["total"], total["period"], total["share_percent"], total["change_percent"]) == (8, None, 100.0, None)


def test_all_dimensions_from_one_scan_equal_each_alone(spark, rows):
    data = [(2020 + i % 4, "abc"[i % 3 if i % 7 else 0], i % 5, i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(data, "period int, kind string, code int, flag boolean")
    cells = rates.dimension_cells(df, {"kind": "kind", "code": "code"})
    alone = rates.stability({c: (rates.rate_by_period(df, c), c) for c in ("kind", "code")})
    assert rows(rates.stability_from_cells(cells)) == rows(alone)
    summaries = {"kind": rates.rate_summary(df, "kind"), "code": rates.rate_summary(df, "code").where("code <> 0")}
    thresholds = (1, 81, 120, 10_000)
    alone = ranking.eligible_counts(summaries, thresholds)
    assert rows(ranking.eligible_from_cells(cells, thresholds, {"code": ["0"]})) == rows(alone)
    broken = rates.dimension_cells(df.withColumn("kind", F.nullif("kind", F.lit("a"))), {"kind": "kind"})
    for made in (rates.stability_from_cells(broken), ranking.eligible_from_cells(broken)):
        with pytest.raises(Exception, match="category is NULL"):
            made.collect()

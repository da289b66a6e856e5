from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratescope import functions as fx
from ratescope import sources
from ratescope.operators import contrast as ct
from ratescope.operators import joins
from ratescope.operators import quality as dq
from ratescope.operators import rates
from ratescope.runtime import scratch_path

GOOD = ("1", 2021, "SC", 2, 1, 1, False)
SCHEMA = "id string, period int, uf string, hurt int, light int, grave int, flag boolean"


def rules(df):
    return [
        *dq.not_null("id"),
        dq.in_domain("uf", ["SC", "PR"]),
        dq.in_range("period", 2021, 2025),
        dq.equal("hurt", "sum_of_parts", F.col("light") + F.col("grave")),
        dq.equal("flag", "definition", F.col("grave") > 1),
        dq.of_type(df, "hurt", "int"),
    ]


@pytest.mark.parametrize(
    "row,broken",
    [
        (GOOD, set()),
        ((None, 2021, "SC", 2, 1, 1, False), {("id", "not_null")}),
        (("1", 2021, "XX", 2, 1, 1, False), {("uf", "domain")}),
        (("1", 2020, "SC", 2, 1, 1, False), {("period", "range")}),
        (("1", 2021, "SC", 5, 1, 1, False), {("hurt", "sum_of_parts")}),
        (("1", 2021, "SC", 2, 1, 1, True), {("flag", "definition")}),
        (("1", 2030, "XX", 2, 1, 1, False), {("uf", "domain"), ("period", "range")}),
    ],
)
def test_each_rule_finds_its_violation(spark, row, broken):
    df = spark.createDataFrame([row, GOOD], SCHEMA)
    found = dq.check_rules(df, rules(df)).where("violations > 0").collect()
    assert {(r["column"], r["rule"]) for r in found} == broken
    if broken:
        with pytest.raises(ValueError, match="contract violated"):
            dq.assert_rules(df, rules(df))
    else:
        dq.assert_rules(df, rules(df))


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "id int")
    assert tuple(dq.check_unique(df, ["id"]).first()) == (5, 3, 3)
    assert tuple(dq.check_unique(df.limit(0), ["id"]).first()) == (0, 0, 0)


def test_combined_profile_counts_ids_repeated_across_periods(spark):
    df = spark.createDataFrame([(1, 2021, True), (1, 2022, False), (2, 2022, False)], "id int, period int, flag boolean")
    got = {r["period"]: r for r in dq.audit_run(df.withColumn("d", F.lit("x")), "id", "d").collect()}
    assert got[2021]["duplicated_rows"] == got[2022]["duplicated_rows"] == 0
    assert got[None]["duplicated_rows"] == 2 and got[None]["rows"] == 3


def test_null_counts_as_a_category(spark, rows):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(dq.category_cardinality(df, ["k"])) == [("k", 2)]
    assert rows(dq.cardinality_table(df, ["k"])) == [("k", 1, 1)]
    assert rows(dq.null_counts(df)) == [("k", 1)]


def test_same_content_ignores_order_and_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (1,), (3,)], "x int")
    r = dq.same_content(a, b).first()
    assert (r["same_schema"], r["only_left"], r["only_right"]) == (True, 1, 1)
    r = dq.same_content(a, a.repartition(3)).first()
    assert (r["only_left"], r["only_right"]) == (0, 0)


def test_content_hash_follows_content(spark):
    df = spark.range(500).select("id", F.lit(1).alias("period"), F.lit(True).alias("flag"))

    def mark(d):
        return dq.dataset_fingerprint(d, "id").first()["content_hash"]

    assert mark(df) == mark(df.repartition(7))
    assert mark(df) != mark(df.withColumn("id", F.when(F.col("id") == 3, 4).otherwise(F.col("id"))))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_difference(a, b):
    a, b = Counter(map(tuple, a)), Counter(map(tuple, b))
    return sum((a - b).values()), sum((b - a).values())


@pytest.mark.parametrize("few_rows", [0, 50, 10**6])
@pytest.mark.parametrize("changes", [0, 1, 40, 3_000])
def test_content_by_digests_equals_brute_force(spark, few_rows, changes):
    rng = random.Random(changes)
    rows = [(i % 700, rng.choice(["a", "b", None]), rng.choice([0.5, None, 2.0])) for i in range(3_000)]
    rows += [(1, "hot", 1.0)] * 1_500
    other = list(rows)
    for i in rng.sample(range(len(rows)), changes):
        other[i] = (rows[i][0] + 1, None, rows[i][2]) if i % 2 else rows[0]
    rng.shuffle(other)
    schema = "k int, name string, x double"
    left, right = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(other, schema)
    r = dq.same_content(left, right, few_rows).first()
    assert (r["same_schema"], r["left_rows"], r["right_rows"]) == (True, len(rows), len(other))
    assert (r["only_left"], r["only_right"]) == brute_difference(rows, other)


def test_equal_tables_shuffle_no_rows(spark):
    df = spark.range(5_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    done = dq.same_content(df, df.repartition(5))
    assert "wide" not in plan_of(done) and tuple(done.first()) == (True, 5_000, 5_000, 0, 0)
    changed = dq.same_content(df, df.where("id <> 77"), 0)
    assert "BroadcastHashJoin" in plan_of(changed) and tuple(changed.first())[1:] == (5_000, 4_999, 1, 0)


def test_content_of_empty_tables(spark):
    df = spark.createDataFrame([(1,), (1,)], "x int")
    assert tuple(dq.same_content(df.limit(0), df.limit(0)).first()) == (True, 0, 0, 0, 0)
    assert tuple(dq.same_content(df.limit(0), df).first()) == (True, 0, 2, 0, 2)


def test_hashes_see_moved_nulls_nested_values_and_one_zero(spark):
    schema = "x int, y int, a array<int>, m map<string, int>, d double"
    rows = [(1, None, [1, None], {"k": 1}, 0.0), (None, 1, [1, None], {"k": 1}, 0.0), (1, None, [None, 1], {"k": 1}, 0.0),
            (1, None, [1, None], {"k": None}, 0.0), (1, None, [1, None], None, 0.0), (1, None, [1, None], {"k": 1}, -0.0)]
    df = spark.createDataFrame(rows, schema)
    for salt in (0, 1):
        hashes = [r[0] for r in df.select(fx.row_hash(df, df.columns, salt)).collect()]
        assert len(set(hashes)) == 5 and hashes[0] == hashes[5]
    other = spark.createDataFrame([(1, None), (2, 2)], "x int, y int")
    swapped = spark.createDataFrame([(None, 1), (2, 2)], "x int, y int")
    assert dq.same_content(other, swapped).first()["only_left"] == 1


def test_groups_that_changed(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (3, "w")], "period int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (4, "w"), (2, "y"), (2, "q")], "period int, v string")
    got = rows(dq.compare_groups(a, b.where("v <> 'q'"), "period"))
    assert got == [(1, 2, 1, False), (2, 1, 2, False), (3, 1, 0, False), (4, 0, 1, False), (None, 1, 1, True)]
    with pytest.raises(ValueError, match="different columns"):
        dq.compare_groups(a, b.withColumn("w", F.lit(1)), "period")


def test_counts_of_columns_copy_no_rows_per_column(spark):
    schema = "i int, s string, d double, b binary, t timestamp, a array<int>"
    values = [(1, "x", 0.0, b"\x00", None, [1]), (1, "X", -0.0, b"0", None, [1, None]), (None, "", float("nan"), None, None, [1]), (2, None, float("nan"), b"0", None, None)]
    df = spark.createDataFrame(values, schema)
    table = dq.data_quality_table(df)
    assert "Expand" not in plan_of(table)
    got = {r["column"]: (r["dtype"], r["null_count"], r["null_percent"], r["distinct_non_null"]) for r in table.collect()}
    assert got == {
        "i": ("int", 1, 25.0, 2), "s": ("string", 1, 25.0, 3), "d": ("double", 0, 0.0, 2), "b": ("binary", 1, 25.0, 2),
        "t": ("timestamp", 4, 100.0, 0), "a": ("array<int>", 1, 25.0, 2),
    }
    near = {r["column"]: tuple(r)[1:] for r in dq.data_quality_table(df, approximate=True).collect()}
    assert near == got
    for approximate in (False, True):
        nothing = dq.data_quality_table(df.limit(0), ["i", "s"], approximate).orderBy("column").collect()
        assert [tuple(r) for r in nothing] == [("i", "int", 0, None, 0), ("s", "string", 0, None, 0)]


def test_merged_sketches_equal_those_of_the_whole(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 7).alias("period"), (F.col("id") % 11).alias("other"), (F.col("id") % 20_011).alias("k"),
        F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("s"),
    )
    merged = [
        {r["column"]: tuple(r) for r in dq.merged_cardinality(dq.cardinality_sketches(df, ["k", "s"], by)).collect()}
        for by in (["period"], ["other"], ["period", "other"])
    ]
    assert merged[0] == merged[1] == merged[2]
    for column, want in (("k", 20_011), ("s", 54_000)):
        assert abs(merged[0][column][3] / want - 1) < 0.05
    assert merged[0]["s"][1:3] == (60_000, 6_000)


def test_prediction_checks(spark, rows):
    schema = "id int, period int, fold int, flag boolean, score double"
    source = spark.createDataFrame([(1, 2022, True), (2, 2022, False), (3, 2023, True)], "id int, period int, flag boolean")
    bad = spark.createDataFrame(
        [(1, 2022, 1, False, 0.5), (2, 2022, 9, False, float("nan")), (2, 2022, 1, False, 1.5), (4, 2023, 2, True, 0.1)], schema
    )
    got = dict(rows(dq.check_predictions(bad, source, "id", "score", {2022: 1, 2023: 2})))
    assert got == {
        "score_out_of_range": 2, "wrong_fold": 1, "duplicated_ids": 2, "unknown_ids": 1, "flag_differs": 1, "period_differs": 0,
        "missing_ids": 1, "null_flag": 0, "duplicated_source_ids": 0,
    }
    twice = source.union(source.where("id = 1"))
    bad = bad.where("id = 1").withColumn("flag", F.lit(None).cast("boolean"))
    got = dict(rows(dq.check_predictions(bad, twice, "id", "score", {2022: 1})))
    assert (got["missing_ids"], got["null_flag"], got["duplicated_source_ids"], got["score_out_of_range"]) == (2, 1, 2, 0)


def test_tables_with_other_columns_share_nothing(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(1, 2)], "x int, y int")
    assert tuple(dq.same_content(a, b).first()) == (False, 2, 1, 2, 1)


# --- joins -----------------------------------------------------------------------------------


def test_join_cardinality(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    right = spark.createDataFrame([(1, 5)], "k int, v int")
    assert joins.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, right, ["k"], cardinality="1:1").collect()
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, right.union(right), ["k"]).collect()
    doubled = joins.checked_join(left, right.union(right), ["k"])
    for unread in (doubled.select("k"), doubled.groupBy().count(), joins.checked_join(left, right.union(right).select("k"), ["k"])):
        with pytest.raises(Exception, match="not unique"):
            unread.collect()


def test_alignment(spark):
    a = spark.createDataFrame([(1, True), (2, False)], "id int, flag boolean")
    b = spark.createDataFrame([(1, True, 0.5), (2, False, 0.1)], "id int, flag boolean, score double")
    assert joins.align_tables(a, b, ["id"], ["flag"]).columns == ["id", "flag", "score"]
    assert joins.align_tables(a, b, ["id"], ["flag"]).count() == 2
    for other in (b.where("id = 1"), b.withColumn("flag", ~F.col("flag"))):
        with pytest.raises(Exception, match="disagree"):
            joins.align_tables(a, other, ["id"], ["flag"]).collect()
        with pytest.raises(Exception, match="disagree"):
            joins.align_tables(a, other, ["id"], ["flag"]).count()


def test_union_of_different_types_is_refused(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("1",)], "x string")
    with pytest.raises(ValueError):
        joins.union_strict([a, b])


# --- sources ---------------------------------------------------------------------------------


@pytest.fixture
def text(spark, tmp_path):
    def write(content, encoding="cp1252", name="x.csv"):
        path = tmp_path / name
        path.write_bytes(content.encode(encoding))
        return str(path)

    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return write


def test_code_page_and_null_tokens(spark, text):
    path = text("id;nome\n1;preço – €\n2;NA\n3;N/A\n4;\n")
    got = sources.read_delimited_strict(spark, path, ["id", "nome"]).collect()
    assert [r["nome"] for r in got] == ["preço – €", None, None, None]


@pytest.mark.parametrize("content", ["id;other\n1;a\n", "nome;id\n1;a\n", "id;nome\n1;a;9\n", "id;nome\n1\n"])
def test_wrong_header_and_ragged_rows_fail(spark, text, content):
    with pytest.raises(Exception):
        sources.read_delimited_strict(spark, text(content), ["id", "nome"]).collect()
    with pytest.raises(Exception):
        sources.read_delimited_strict(spark, text(content), ["id", "nome"]).select("id").collect()


def test_code_page_needs_the_session_setting(spark, text):
    path = text("id\n1\n")
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    with pytest.raises(ValueError, match="javaCharsets"):
        sources.read_delimited_strict(spark, path, ["id"])


TYPES = {
    "text": ["uf"], "dates": ["day"], "times": ["clock"], "integers": ["dead", "grave"],
    "lenient_integers": ["br"], "decimals": ["km"], "flag_counts": ["dead", "grave"],
}
COLUMNS = ["day", "clock", "uf", "br", "km", "dead", "grave"]


def typed(spark, *row):
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in COLUMNS))
    return sources.standardize_types(df, 2021, **TYPES).first()


def test_typing(spark):
    r = typed(spark, "2021-03-04", "23:59:01", " SC ", "x", " 12,5", "0", " 2")
    assert (str(r["day"]), r["clock"], r["uf"], r["br"], r["km"], r["grave"]) == ("2021-03-04", "23:59:01", "SC", None, 12.5, 2)
    assert (r["period"], r["flag"]) == (2021, True)


@pytest.mark.parametrize("column,value", [("day", "04/03/2021"), ("clock", "25:00:00"), ("dead", "one")])
def test_strict_types_fail(spark, column, value):
    row = dict(zip(COLUMNS, ["2021-03-04", "10:00:00", "SC", "1", "1,0", "0", "0"]))
    with pytest.raises(Exception):
        typed(spark, *{**row, column: value}.values())


def test_no_table_to_stack(spark):
    with pytest.raises(ValueError):
        sources.union_periods([])


def test_period_filter_prunes_folders_and_columns(spark):
    path = scratch_path(spark, "pruned")
    df = spark.range(100).select("id", (F.col("id") % 4 + 2021).alias("period"), F.lit("x").alias("wide"))
    sources.write_columnar(df, path, "period")
    got = sources.scan_period(spark, path, [2022], ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan or "PartitionFilters: [(period" in plan
    assert "wide" not in plan.split("ReadSchema:")[1]
    assert got.count() == 25


def test_files_of_a_period_follow_from_its_bytes(spark):
    rows = 12_000
    half = F.when(F.col("id") % 2 == 0, 2021).when(F.col("id") % 100 == 1, None).otherwise(2022 + F.col("id") % 3)
    df = spark.range(rows).select("id", half.cast("int").alias("period"), F.lit("x" * 20).alias("text")).repartition(7)
    path = scratch_path(spark, "clustered")
    sources.write_columnar(df, path, "period", bytes_per_file=36_000)  # 36 bytes a row
    stored = spark.read.parquet(path)
    files = stored.withColumn("f", F.input_file_name()).groupBy("period").agg(F.count_distinct("f"), F.count("*")).collect()
    for period, number, n in files:
        assert number == -(-n * 36 // 36_000), period
    assert dq.same_content(df, sources.read_columnar(spark, path, df.columns)).first()["only_left"] == 0
    assert stored.count() == rows and len(files) == 5
    tasks = sources.clustered(df, "period", 36_000).select(F.spark_partition_id().alias("p"), "period").distinct()
    assert tasks.groupBy("p").count().where("count > 1").count() == 0
    assert tasks.where("period = 2021").count() == 6
    empty = scratch_path(spark, "nothing")
    sources.write_columnar(df.limit(0), empty, "period")


def test_cube_json_rejects_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "p double")
    with pytest.raises(Exception, match="not finite"):
        sources.write_cube_json(df, scratch_path(spark, "cube"))


# --- contrasts -------------------------------------------------------------------------------


def test_contrast_picks(spark):
    rows = []
    for kind, total, flagged in (("a", 10, 9), ("b", 20, 2), ("c", 3, 3), ("d", 20, 4)):
        rows += [(2021 + i % 2, kind, i < flagged) for i in range(total)]
    df = spark.createDataFrame(rows, "period int, kind string, flag boolean")
    pick, spec = ct.Pick, ct.Contrast
    got = ct.contrast_matrix(
        df,
        [
            spec("kind", pick("highest_rate"), pick("lowest_rate")),
            spec("kind", pick("highest_rate", minimum_rows=5), pick("highest_volume")),
            spec("kind", pick("highest_rate", excluded=("c",)), pick("value", "d")),
            spec("kind", pick("value", "c"), None),
        ],
        minimum_rows=10,
    ).collect()
    assert [r["comparison"] for r in got] == ["c vs b", "a vs b", "a vs d", "c (special category)"]
    assert [r["sample_flag"] for r in got] == ["small_sample", "sufficient", "sufficient", "data_quality"]
    assert got[1]["difference_points"] == 80.0 and not got[3]["substantive"]


def test_contrast_without_its_category_fails(spark):
    df = spark.createDataFrame([(2021, "a", True)], "period int, kind string, flag boolean")
    with pytest.raises(Exception, match="no category"):
        ct.contrast(df, "kind", "a", "zz").collect()


def test_global_row(spark):
    df = spark.createDataFrame([(2021, True), (2021, False), (2022, True)], "period int, flag boolean")
    r = ct.global_row(rates.period_summary(df)).first()
    assert (r["rate_percent"], r["reference_rate_percent"], r["range_points"]) == (100.0, 50.0, 50.0)


def test_month_label_mismatch_is_counted(spark):
    df = spark.createDataFrame(
        [(2021, "2021-02-01", "February"), (2021, "2021-03-01", "May"), (2021, "bad", "May")],
        "period int, day string, month_name string",
    )
    label = fx.month_name(F.col("day").try_cast("date"))
    r = dq.calendar_coverage(df, "day", "month_name", label).first()
    assert (r["parseable_rows"], r["covered_months"], r["consistent_rows"]) == (2, 2, 1)
    assert r["missing_months"] == "1|4|5|6|7|8|9|10|11|12"

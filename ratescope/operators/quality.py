"""Data-quality checks. A list of rules becomes one aggregation over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.functions import in_unit_interval, is_flagged, month_number, percent, row_hash, text_of


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for a row that violates the rule; NULL counts as kept."""

    column: str
    name: str
    broken: Column


def not_null(*columns: str) -> list[Rule]:
    return [Rule(c, "not_null", F.col(c).isNull()) for c in columns]


def in_domain(column: str, values: Sequence) -> Rule:
    return Rule(column, "domain", ~F.col(column).isin(*values))


def in_range(column: str, low=None, high=None) -> Rule:
    broken = F.lit(False)
    if low is not None:
        broken = broken | (F.col(column) < low)
    if high is not None:
        broken = broken | (F.col(column) > high)
    return Rule(column, "range", broken)


def of_type(df: DataFrame, column: str, data_type: str) -> Rule:
    """Known from the schema: every row breaks it or none does."""
    wrong = column not in df.columns or df.schema[column].dataType.simpleString() != data_type
    return Rule(column, "type", F.lit(wrong))


def equal(column: str, name: str, expected: Column) -> Rule:
    """Cross-column rule: the column equals an expression over other columns."""
    return Rule(column, name, F.col(column) != expected)


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(column, rule, violations) for all rules, from a single aggregation."""
    counted = df.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(
                F.lit(r.column).alias("column"),
                F.lit(r.name).alias("rule"),
                F.col(f"r{i}").alias("violations"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counted.select(F.inline(rows))


def assert_rules(df: DataFrame, rules: Sequence[Rule]) -> None:
    """Runs the check and raises one error listing all broken rules."""
    broken = check_rules(df, rules).where("violations > 0").collect()
    if broken:
        text = "; ".join(f"{r['column']} {r['rule']}: {r['violations']}" for r in broken)
        raise ValueError(f"contract violated: {text}")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and rows that share their key with another row."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_rows"),
        )
    )


# --- profiles --------------------------------------------------------------------------------


def _per_id(
    df: DataFrame, keys: list[str], date: str, flag: str, checks: Mapping[str, Column]
) -> DataFrame:
    """Group by (period, id) once: duplicates and all other measures come from the same shuffle."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(date).alias("lo"),
        F.max(date).alias("hi"),
        F.count_if(is_flagged(flag)).alias("flagged"),
        *[F.count_if(test).alias(name) for name, test in checks.items()],
    )


def _profile(per_id: DataFrame, keys: list[str], checks: Mapping[str, Column]) -> DataFrame:
    rows, flagged = F.sum("n"), F.sum("flagged")
    return per_id.groupBy(*keys).agg(
        rows.alias("rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_rows"),
        F.min("lo").alias("date_min"),
        F.max("hi").alias("date_max"),
        flagged.alias("flagged"),
        (rows - flagged).alias("unflagged"),
        F.round(flagged / rows, 6).alias("rate"),
        *[F.sum(name).alias(name) for name in checks],
    )


def profile_period(
    df: DataFrame,
    key_id: str,
    date: str,
    checks: Mapping[str, Column] | None = None,
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """Rows, duplicated ids, date span, flag counts and named condition counts per period."""
    checks = checks or {}
    return _profile(_per_id(df, [period, key_id], date, flag, checks), [period], checks)


def audit_run(
    df: DataFrame,
    key_id: str,
    date: str,
    checks: Mapping[str, Column] | None = None,
    flag: str = "flag",
    period: str = "period",
) -> DataFrame:
    """``profile_period`` plus one combined row (period NULL), where an id repeated across periods
    also counts as duplicated."""
    checks = checks or {}
    per_id = _per_id(df, [period, key_id], date, flag, checks)
    each = _profile(per_id, [period], checks)
    # The combined row adds up the same cells per id, so the table is scanned once.
    per_id_overall = per_id.groupBy(key_id).agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *[F.sum(c).alias(c) for c in ("flagged", *checks)],
    )
    combined = _profile(per_id_overall, [], checks)
    return each.unionByName(combined, allowMissingColumns=True)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that hold NULLs, with their number."""
    names = list(columns or df.columns)
    return (
        check_rules(df, not_null(*names)).where("violations > 0").select(
            "column", F.col("violations").alias("null_count")
        )
    )


def cardinality_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by…, column, rows, null_count, sketch): one mergeable sketch of the distinct values per column.

    One scan, and per group one row per column. Stored per period, the sketches answer any set of periods through
    ``merged_cardinality`` without reading the table again.
    """
    per_group = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
        # Sketches pass over empty texts, so that none may be empty.
        *[F.hll_sketch_agg(F.concat(F.lit("="), text_of(df, c))).alias(f"_s{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("_rows").alias("rows"),
                F.col(f"_n{i}").alias("null_count"),
                F.col(f"_s{i}").alias("sketch"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return per_group.select(*by, F.inline(rows))


def merged_cardinality(sketches: DataFrame) -> DataFrame:
    """(column, rows, null_count, distinct_non_null) from stored sketches, distinct values within about 2%."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_non_null"),
    )


def _column_counts(df: DataFrame, columns: Sequence[str], approximate: bool) -> DataFrame:
    """(at, column, rows, null_count, distinct_non_null); ``at`` is the column's place in the list.

    Exact counts come from (column, value) cells, aggregated before they are shuffled. A table without rows gives zeros.
    """
    names = list(columns)
    if approximate:
        places = F.array(*[F.lit(c) for c in names])
        found = merged_cardinality(cardinality_sketches(df, names))
        return found.withColumn("at", F.array_position(places, F.col("column")).cast("int") - 1)
    pairs = F.array(
        *[F.struct(F.lit(i).alias("at"), text_of(df, c).alias("value")) for i, c in enumerate(names)]
    )
    measures = ("rows", "null_count", "distinct_non_null")
    found = (
        df.select(F.inline(pairs))
        .groupBy("at", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("at")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
            F.count("value").alias("distinct_non_null"),
        )
        .agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct(*measures)))).alias("found"))
    )
    listed = found.select("found", F.posexplode(F.array(*[F.lit(c) for c in names])).alias("at", "column"))
    mine = F.try_element_at("found", F.col("at"))
    return listed.select(
        "at", "column", *[F.coalesce(mine[m], F.lit(0).cast("bigint")).alias(m) for m in measures]
    )


def category_cardinality(
    df: DataFrame, columns: Sequence[str], approximate: bool = False
) -> DataFrame:
    """Distinct values per column; NULL counts as a value."""
    null_value = F.when(F.col("null_count") > 0, 1).otherwise(0)
    return _column_counts(df, columns, approximate).select(
        "column", (F.col("distinct_non_null") + null_value).alias("distinct_values")
    )


def cardinality_table(
    df: DataFrame, columns: Sequence[str], approximate: bool = False
) -> DataFrame:
    """Distinct non-NULL values and NULLs per column."""
    return _column_counts(df, columns, approximate).select("column", "distinct_non_null", "null_count")


def data_quality_table(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Type, NULLs, NULL percentage (NULL for a table without rows) and distinct non-NULL values per column."""
    names = list(columns or df.columns)
    types = F.array(*[F.lit(df.schema[c].dataType.simpleString()) for c in names])
    return _column_counts(df, names, approximate).select(
        "column",
        F.get(types, F.col("at")).alias("dtype"),
        "null_count",
        F.when(F.col("rows") > 0, percent("null_count", "rows")).alias("null_percent"),
        "distinct_non_null",
    )


def special_category_table(
    df: DataFrame, columns: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Count and percentage of each special value in each column."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if(F.col(c) == v).alias(f"c{i}_{j}")
            for i, c in enumerate(columns)
            for j, v in enumerate(values)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(v).alias("special_category"),
                F.col(f"c{i}_{j}").alias("count"),
                percent(f"c{i}_{j}", "rows").alias("percent_of_rows"),
            )
            for i, c in enumerate(columns)
            for j, v in enumerate(values)
        ]
    )
    return counted.select(F.inline(rows))


def coverage_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    """NULLs of both columns and distinct pairs, a pair with NULL included."""
    rows = F.array(
        F.struct(F.lit(f"{first}_null_count").alias("metric"), F.col("a").alias("value")),
        F.struct(F.lit(f"{second}_null_count").alias("metric"), F.col("b").alias("value")),
        F.struct(F.lit("distinct_pairs").alias("metric"), F.col("pairs").alias("value")),
    )
    return (
        df.groupBy(first, second)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum(F.when(F.col(first).isNull(), F.col("n"))), F.lit(0)).alias("a"),
            F.coalesce(F.sum(F.when(F.col(second).isNull(), F.col("n"))), F.lit(0)).alias("b"),
            F.count(F.lit(1)).alias("pairs"),
        )
        .select(F.inline(rows))
    )


def distinct_tokens(df: DataFrame, field: str, delimiter: str = ";") -> DataFrame:
    """Distinct trimmed tokens of a multi-valued field in name order."""
    return (
        df.select(F.explode(F.split(field, delimiter)).alias("token"))
        .select(F.trim("token").alias("token"))
        .where(F.col("token").isNotNull())
        .distinct()
        .orderBy("token")
    )


# --- comparing tables ------------------------------------------------------------------------


#: Differing buckets of at most so many rows are compared row by row without looking for smaller buckets first.
FEW_ROWS = 1_000_000
#: Bits of the bucket numbers at the first and the second level; so many digests reach the driver at most.
LEVELS = (8, 16)


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables, with 1 in ``_l`` or ``_r``."""
    return left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(
        right.withColumns({"_l": F.lit(0), "_r": F.lit(1)})
    )


def _digests(tagged: DataFrame, names: Sequence[str], by: Sequence[str | Column]) -> DataFrame:
    """Rows of both sides per group, and whether the sums of their row hashes differ.

    Sums take no notice of row order and count repeated rows. They are of two independent hashes of 64 bits, so that
    different groups look equal with a probability of about 2**-128.
    """

    def difference(salt: int) -> Column:
        hashed = row_hash(tagged, names, salt).cast("decimal(28,0)")
        return F.sum(F.when(F.col("_l") == 1, hashed).otherwise(-hashed))

    left, right = F.sum("_l"), F.sum("_r")
    return tagged.groupBy(*by).agg(
        left.alias("left_rows"),
        right.alias("right_rows"),
        ((left != right) | (difference(0) != 0) | (difference(1) != 0)).alias("differs"),
    )


def same_content(left: DataFrame, right: DataFrame, few_rows: int = FEW_ROWS) -> DataFrame:
    """One row: schema equality and the rows found on one side only, duplicates counted.

    Rows fall into buckets by their hash, and buckets are compared by digests first: equal tables are scanned once and no row
    is shuffled. Where buckets of more than ``few_rows`` rows differ, smaller buckets inside them follow. Only the rows of
    buckets that still differ are compared one by one.

    Row order is not a property of a Spark table and is not compared. Tables with different column
    names share no row.
    """
    same_schema = left.dtypes == right.dtypes
    names = left.columns
    if sorted(names) != sorted(right.columns):
        rows = left.agg(F.count(F.lit(1)).alias("left_rows")).withColumn(
            "right_rows", right.agg(F.count(F.lit(1)).alias("n")).scalar()
        )
        return rows.select(
            F.lit(False).alias("same_schema"),
            "left_rows",
            "right_rows",
            F.col("left_rows").alias("only_left"),
            F.col("right_rows").alias("only_right"),
        )
    rest, totals = _both(left, right), None
    for bits in LEVELS:
        bucket = row_hash(rest, names).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("_bucket")
        found = _digests(rest, names, [bucket]).collect()
        totals = totals or (sum(r["left_rows"] for r in found), sum(r["right_rows"] for r in found))
        differing = [r for r in found if r["differs"]]
        if not differing:
            rest = rest.where(F.lit(False))
        elif len(differing) < len(found):
            buckets = left.sparkSession.createDataFrame([(r["_bucket"],) for r in differing], "_bucket bigint")
            # At most one row per bucket of this level.
            rest = rest.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket").drop("_bucket")
        if sum(r["left_rows"] + r["right_rows"] for r in differing) <= few_rows:
            break
    extra = F.col("l") - F.col("r")
    only_left, only_right = F.sum(F.when(extra > 0, extra)), F.sum(F.when(extra < 0, -extra))
    return (
        rest.groupBy(*names)
        .agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
        .agg(only_left.alias("a"), only_right.alias("b"))
        .select(
            F.lit(same_schema).alias("same_schema"),
            F.lit(totals[0]).cast("bigint").alias("left_rows"),
            F.lit(totals[1]).cast("bigint").alias("right_rows"),
            F.coalesce("a", F.lit(0)).cast("bigint").alias("only_left"),
            F.coalesce("b", F.lit(0)).cast("bigint").alias("only_right"),
        )
    )


def compare_groups(left: DataFrame, right: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """(by…, left_rows, right_rows, same): which groups, such as periods, hold the same rows in both tables.

    Both tables are scanned once and only digests are shuffled. NULL is a group like any other. Tables with
    different column names are refused.
    """
    names = left.columns
    if sorted(names) != sorted(right.columns):
        raise ValueError("the tables have different columns")
    keys = [by] if isinstance(by, str) else list(by)
    found = _digests(_both(left, right), names, keys)
    return found.select(*keys, "left_rows", "right_rows", (~F.col("differs")).alias("same"))


def dataset_fingerprint(
    df: DataFrame, key_id: str, flag: str = "flag", period: str = "period"
) -> DataFrame:
    """Rows, columns, period span, flag count, distinct ids, NULL cells and a content hash.

    The hash adds up per-row hashes, so it depends neither on row order nor on partitioning.
    """
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    hashed = row_hash(df, df.columns).cast("decimal(28,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_distinct(period).alias("periods"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        F.count_if(is_flagged(flag)).alias("flagged"),
        F.count_distinct(key_id).alias("distinct_ids"),
        F.sum(nulls).alias("null_cells"),
        F.sum(hashed).cast("string").alias("content_hash"),
    )


def check_periods(df: DataFrame, expected: Sequence[int], period: str = "period") -> DataFrame:
    """Every expected or present period with both marks."""
    wanted = df.sparkSession.createDataFrame([(int(p),) for p in expected], f"{period} int")
    return (
        df.groupBy(period)
        .agg(F.lit(True).alias("present"))
        .join(wanted.withColumn("expected", F.lit(True)), period, "full_outer")
        .select(
            period,
            F.coalesce("expected", F.lit(False)).alias("expected"),
            F.coalesce("present", F.lit(False)).alias("present"),
        )
    )


# --- coverage --------------------------------------------------------------------------------


def calendar_coverage(
    df: DataFrame,
    date: str,
    month_label: str,
    label_of: Column,
    period: str = "period",
) -> DataFrame:
    """Per period: parseable dates, distinct dates, months covered and missing, span, and how often
    the stored month label equals ``label_of``."""
    parsed = df.withColumn("_d", F.col(date).try_cast("date"))
    months = F.array_sort(F.collect_set(month_number("_d")))
    return (
        parsed.groupBy(period)
        .agg(
            F.count(date).alias("non_null_rows"),
            F.count("_d").alias("parseable_rows"),
            F.count_distinct("_d").alias("distinct_values"),
            months.alias("months"),
            F.min("_d").cast("string").alias("minimum_value"),
            F.max("_d").cast("string").alias("maximum_value"),
            F.count_if(F.col(month_label) == label_of).alias("consistent_rows"),
        )
        .select(
            F.lit(date).alias("variable"),
            period,
            "non_null_rows",
            "parseable_rows",
            "distinct_values",
            F.size("months").alias("covered_months"),
            F.concat_ws(
                "|", F.array_except(F.sequence(F.lit(1), F.lit(12)), "months").cast("array<string>")
            ).alias("missing_months"),
            "minimum_value",
            "maximum_value",
            "consistent_rows",
        )
    )


def time_coverage(df: DataFrame, time: str, hour: str, period: str = "period") -> DataFrame:
    """Per period: parseable times, distinct times, span, and how often the stored hour agrees."""
    parsed = df.withColumn("_t", F.date_format(F.try_to_timestamp(time, F.lit("HH:mm:ss")), "HH:mm:ss"))
    return parsed.groupBy(period).agg(
        F.lit(time).alias("variable"),
        F.count(time).alias("non_null_rows"),
        F.count("_t").alias("parseable_rows"),
        F.count_distinct("_t").alias("distinct_values"),
        F.min("_t").alias("minimum_value"),
        F.max("_t").alias("maximum_value"),
        F.count_if(F.substring("_t", 1, 2).cast("int").eqNullSafe(F.col(hour))).alias(
            "consistent_rows"
        ),
    )


# --- model inputs and outputs ----------------------------------------------------------------


def predictor_rules(
    df: DataFrame, predictors: Sequence[str], binary: Sequence[str] = ()
) -> list[Rule]:
    """Predictors present and filled; binaries are 0 or 1; floating predictors are finite."""
    rules = []
    for c in predictors:
        if c not in df.columns:
            rules.append(Rule(c, "present", F.lit(True)))
            continue
        rules += not_null(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            infinite = F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
            rules.append(Rule(c, "finite", infinite))
        if c in binary:
            rules.append(Rule(c, "binary", ~F.col(c).isin(0, 1)))
    return rules


def check_predictors(
    df: DataFrame, predictors: Sequence[str], binary: Sequence[str] = ()
) -> DataFrame:
    return check_rules(df, predictor_rules(df, predictors, binary))


def check_predictions(
    predictions: DataFrame,
    source: DataFrame,
    key_id: str,
    score: str,
    fold_of_period: Mapping[int, int] | None = None,
    flag: str = "flag",
    period: str = "period",
    fold: str = "fold",
) -> DataFrame:
    """(check, violations): probability range, fold of period, unique ids on both sides, ids found on one
    side only, flags given, flag and period equal to the source."""
    wrong_fold = F.lit(False)
    if fold_of_period is not None:
        pairs = [x for p, k in fold_of_period.items() for x in (F.lit(p), F.lit(k))]
        wrong_fold = ~F.try_element_at(F.create_map(*pairs), F.col(period)).eqNullSafe(F.col(fold))
    known = source.groupBy(key_id).agg(
        F.min(flag).alias("_flag"), F.min(period).alias("_period"), F.count(F.lit(1)).alias("_known")
    )
    per_id = predictions.groupBy(key_id).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~in_unit_interval(score)).alias("bad_score"),
        F.count_if(wrong_fold).alias("bad_fold"),
        F.count_if(F.col(flag).isNull()).alias("null_flag"),
        F.min(flag).alias("flag_min"),
        F.max(flag).alias("flag_max"),
        F.min(period).alias("period_min"),
        F.max(period).alias("period_max"),
    )
    predicted, seen = F.col("n").isNotNull(), F.col("_known").isNotNull()
    differs = ~(F.col("flag_min").eqNullSafe(F.col("_flag"))) | ~(
        F.col("flag_max").eqNullSafe(F.col("_flag"))
    )
    moved = ~(F.col("period_min").eqNullSafe(F.col("_period"))) | ~(
        F.col("period_max").eqNullSafe(F.col("_period"))
    )
    counted = per_id.join(known, key_id, "full_outer").agg(
        F.coalesce(F.sum("bad_score"), F.lit(0)).alias("score_out_of_range"),
        F.coalesce(F.sum("bad_fold"), F.lit(0)).alias("wrong_fold"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_ids"),
        F.count_if(~seen).alias("unknown_ids"),
        F.count_if(predicted & seen & differs).alias("flag_differs"),
        F.count_if(predicted & seen & moved).alias("period_differs"),
        F.count_if(~predicted).alias("missing_ids"),
        F.coalesce(F.sum("null_flag"), F.lit(0)).alias("null_flag"),
        F.coalesce(F.sum(F.when(F.col("_known") > 1, F.col("_known"))), F.lit(0)).alias("duplicated_source_ids"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("check"), F.col(c).alias("violations"))
            for c in counted.columns
        ]
    )
    return counted.select(F.inline(rows))

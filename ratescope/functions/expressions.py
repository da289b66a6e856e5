"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A literal map is planned into every task, so its size has to stay small.
MAX_LITERAL_MAP = 1_000


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- flags -----------------------------------------------------------------------------------


def any_positive(*counts: str | Column) -> Column:
    """True when at least one of the counts is above zero."""
    return reduce(lambda a, b: a | b, [column(c) > 0 for c in counts])


def is_flagged(flag: str | Column) -> Column:
    """The flag with NULL read as not flagged."""
    return F.coalesce(column(flag), F.lit(False))


def at_least(score: str | Column, threshold: float) -> Column:
    """Decision rule: the threshold itself is a positive decision."""
    return column(score) >= F.lit(float(threshold))


def outcome_label(flag: str | Column, decision: str | Column) -> Column:
    """TP, FP, FN or TN from the true flag and the decision."""
    y, d = column(flag), column(decision)
    return F.when(d, F.when(y, "TP").otherwise("FP")).otherwise(F.when(y, "FN").otherwise("TN"))


# --- numbers ---------------------------------------------------------------------------------


def percent(part: str | Column, whole: str | Column, digits: int | None = 6) -> Column:
    value = column(part) / column(whole) * 100
    return value if digits is None else F.round(value, digits)


def ratio_or_zero(numerator: str | Column, denominator: str | Column) -> Column:
    return F.coalesce(F.try_divide(column(numerator), column(denominator)), F.lit(0.0))


def point_gap(a: str | Column, b: str | Column, digits: int = 6) -> Column:
    """Absolute difference of two percentages in points."""
    return F.round(F.abs(column(a) - column(b)), digits)


def stable_logistic(margin: str | Column) -> Column:
    """Logistic function that never evaluates exp of a large positive number."""
    m = column(margin)
    small = F.exp(-F.abs(m))
    return F.when(m >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def is_finite(value: str | Column) -> Column:
    v = column(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def in_unit_interval(value: str | Column) -> Column:
    return is_finite(value) & column(value).between(0.0, 1.0)


def count_at_or_below(edges: Column, value: Column) -> Column:
    """Number of edges ``<= value`` (bins closed on the left)."""
    return F.size(F.filter(edges, lambda e: e <= value))


def count_below(edges: Column, value: Column) -> Column:
    """Number of edges ``< value`` (bins closed on the right)."""
    return F.size(F.filter(edges, lambda e: e < value))


# --- strings ---------------------------------------------------------------------------------


def clean_text(value: str | Column, null_tokens: Sequence[str] = ()) -> Column:
    """Trimmed text; any of the null tokens becomes NULL."""
    v = column(value)
    if null_tokens:
        v = F.when(v.isin(*null_tokens), None).otherwise(v)
    return F.trim(v)


def comma_decimal(value: str | Column) -> Column:
    """Lenient double from text with a decimal comma."""
    return F.regexp_replace(F.trim(column(value)), ",", ".").try_cast("double")


def token_array(value: str | Column, delimiter: str = ";") -> Column:
    """Distinct trimmed tokens of one multi-valued text, in their first order."""
    return F.array_distinct(
        F.transform(F.split(column(value), delimiter), lambda token: F.trim(token))
    )


def category_label(value: str | Column) -> Column:
    """Category as text; NULL is a category of its own called ``<NULL>``."""
    return F.coalesce(column(value).cast("string"), F.lit("<NULL>"))


def place_label(name: str | Column, area: str | Column, separator: str = " - ") -> Column:
    return F.concat_ws(separator, column(name), column(area))


def code_label(
    code: str | Column,
    prefix: str = "BR ",
    unknown_code: int = 0,
    unknown_label: str = "not identified",
) -> Column:
    """Prefix plus code, with one code reserved for 'not identified'."""
    c = column(code)
    return F.when(c == unknown_code, unknown_label).otherwise(
        F.concat(F.lit(prefix), c.cast("string"))
    )


# --- lookups ---------------------------------------------------------------------------------


def _literal_map(mapping: Mapping) -> Column:
    if len(mapping) > MAX_LITERAL_MAP:
        raise ValueError("mapping too large for a literal; join a mapping table instead")
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def map_strict(mapping: Mapping, key: str | Column, what: str = "value") -> Column:
    """Mapped value; a key outside the map fails the query, NULL stays NULL."""
    k = column(key)
    message = F.concat(F.lit(f"unmapped {what}: "), k.cast("string"))
    found = F.try_element_at(_literal_map(mapping), k)
    return F.when(k.isNull(), None).otherwise(F.coalesce(found, F.raise_error(message)))


def map_default(mapping: Mapping, key: str | Column, default) -> Column:
    """Mapped value, or the default for an unknown key."""
    return F.coalesce(F.try_element_at(_literal_map(mapping), column(key)), F.lit(default))


def required(value: str | Column, what: str) -> Column:
    """The value itself; NULL fails the query."""
    v = column(value)
    return F.when(v.isNull(), F.raise_error(F.lit(f"{what} is NULL"))).otherwise(v)


def demand(condition: Column, message: str | Column) -> Column:
    """True where the condition holds; a row where it does not fails the query.

    Meant for a filter: the optimizer drops unread columns with the checks in them, a filter stays.
    """
    failed = F.raise_error(F.lit(message)).cast("boolean")
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(failed)


def all_present(names: Sequence[str]) -> Column:
    """Filter: True where none of the columns is NULL; a row with a NULL fails the query."""
    return reduce(lambda a, b: a & b, [demand(F.col(n).isNotNull(), f"{n} is NULL") for n in names], F.lit(True))


def order_rank(order: Sequence, value: str | Column, what: str = "category") -> Column:
    """0-based position of the value in a fixed order; outside the order the query fails."""
    return map_strict({v: i for i, v in enumerate(order)}, value, what)


# --- whole values and rows -------------------------------------------------------------------

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def text_of(df: DataFrame, name: str) -> Column:
    """The value of any type as text: equal values give equal text, different ones different text; NULL stays NULL.

    Times go by their instant, because local times repeat when clocks are set back. Both zeros are one.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(name).cast("double") + F.lit(0.0)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(name)
    if isinstance(kind, _NESTED):
        return F.to_json(name, {"ignoreNullFields": "false"})
    return F.col(name).cast("string")


def row_hash(df: DataFrame, names: Sequence[str], salt: int = 0) -> Column:
    """64-bit hash of a row's values. Other salts give other hashes of the same row.

    Spark's hash passes over NULLs, so that a value and a NULL could change places unseen; the hash
    therefore also covers which columns are NULL.
    """
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names])
    values = [text_of(df, c) if isinstance(df.schema[c].dataType, _NESTED) else F.col(c) for c in names]
    return F.xxhash64(F.lit(salt), gaps, *values)


def row_bytes(df: DataFrame, names: Sequence[str]) -> Column:
    """About how many bytes a row's values take uncompressed: lengths of texts, 8 for any other value."""
    sizes = []
    for c in names:
        kind = df.schema[c].dataType
        long = isinstance(kind, (T.StringType, T.BinaryType, *_NESTED))
        value = text_of(df, c) if isinstance(kind, _NESTED) else F.col(c)
        sizes.append(F.coalesce(F.octet_length(value), F.lit(0)) if long else F.lit(8))
    return reduce(lambda a, b: a + b, sizes, F.lit(0).cast("bigint"))


# --- calendar --------------------------------------------------------------------------------

# English labels used when the caller gives none.
MONTH_NAMES = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)
WEEKDAY_NAMES = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)


def month_number(date: str | Column) -> Column:
    return F.month(column(date))


def month_name(date: str | Column, names: Sequence[str] = MONTH_NAMES) -> Column:
    return map_strict(dict(enumerate(names, start=1)), F.month(column(date)), "month")


def iso_weekday(date: str | Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(column(date)) + 1


def weekday_name(date: str | Column, names: Sequence[str] = WEEKDAY_NAMES) -> Column:
    return map_strict(dict(enumerate(names, start=1)), iso_weekday(date), "weekday")


def weekday_group(
    weekday: str | Column,
    working_days: Sequence[str] = WEEKDAY_NAMES[:5],
    labels: tuple[str, str] = ("working day", "weekend"),
) -> Column:
    return F.when(column(weekday).isin(*working_days), labels[0]).otherwise(labels[1])


def time_of_day(value: str | Column, fmt: str = "HH:mm:ss") -> Column:
    """Second of the day, or NULL when the text is not a time."""
    t = F.try_to_timestamp(column(value), F.lit(fmt))
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def time_hour(value: str | Column, fmt: str = "HH:mm:ss") -> Column:
    return F.hour(F.try_to_timestamp(column(value), F.lit(fmt)))


# --- predicates ------------------------------------------------------------------------------


def selection(filters: Mapping[str, Sequence]) -> Column:
    """Facet filter: a column with no selected values is not restricted."""
    chosen = [F.col(name).isin(*values) for name, values in filters.items() if len(values)]
    return reduce(lambda a, b: a & b, chosen, F.lit(True))

"""Multi-valued text fields: one row per distinct token, or one 0/1 column per token."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.functions import demand, is_flagged, percent, token_array
from ratescope.operators.rates import cell_total


def explode_tokens(
    df: DataFrame,
    field: str,
    keep: Sequence[str],
    known: Sequence[str] | None = None,
    delimiter: str = ";",
    token: str = "token",
) -> DataFrame:
    """One row per distinct token of each row.

    With ``known``, another token and a row without a field fail the query, whatever columns are read.
    """
    if known is None:
        return df.select(*keep, F.explode(token_array(field, delimiter)).alias(token))
    out = df.select(*keep, F.explode_outer(token_array(field, delimiter)).alias(token))
    return out.where(_expected(known, token))


def _expected(known: Sequence[str], token: str = "token") -> Column:
    found = F.concat(F.lit("unmapped token: "), F.coalesce(token, F.lit("NULL")))
    return demand(F.col(token).isin(*known), found)


def token_cells(
    df: DataFrame,
    field: str,
    keys: Sequence[str] = (),
    flag: str = "flag",
    known: Sequence[str] | None = None,
    delimiter: str = ";",
) -> DataFrame:
    """(keys…, token, flagged, unflagged, starts) in one pass.

    Rows are counted per text of the field first, and only the different texts are taken apart, so the rows are
    not multiplied by their tokens. ``starts`` counts the rows whose first token this is, so its sum over all
    tokens is the number of rows and the table need not be counted separately. Rows without a field have a NULL
    token; with ``known`` they fail the query, as other tokens do.
    """
    texts = (
        df.select(*keys, is_flagged(flag).alias("_yes"), F.col(field).alias("_text"))
        .groupBy(*keys, "_text")
        .agg(F.count_if("_yes").alias("flagged"), F.count_if(~F.col("_yes")).alias("unflagged"))
    )
    at = F.posexplode_outer(token_array("_text", delimiter)).alias("_at", "token")
    exploded = texts.select(*keys, "flagged", "unflagged", at)
    if known is not None:
        exploded = exploded.where(_expected(known))
    starts = F.when(F.coalesce("_at", F.lit(0)) == 0, cell_total()).otherwise(0)
    return exploded.groupBy(*keys, "token").agg(
        F.sum("flagged").alias("flagged"), F.sum("unflagged").alias("unflagged"), F.sum(starts).alias("starts")
    )


# Both readers of the cells below mention all three measures. Spark prunes unused ones, and with
# different columns it would scan and shuffle the table twice instead of reusing the shuffle.


def cell_rows() -> Column:
    """Aggregate: table rows behind the cells."""
    return F.sum(F.when(cell_total() > 0, F.col("starts")))


def _containing(cells: DataFrame) -> DataFrame:
    return cells.where(F.when(F.col("token").isNotNull(), F.col("starts") >= 0))


def _token_measures(rows: str | Column) -> list[Column]:
    return [
        cell_total().alias("total"),
        F.col("flagged"),
        F.col("unflagged"),
        percent("flagged", cell_total()).alias("rate_percent"),
        percent(cell_total(), rows).alias("containing_percent"),
    ]


def token_rate_summary(
    df: DataFrame,
    field: str,
    flag: str = "flag",
    known: Sequence[str] | None = None,
    delimiter: str = ";",
) -> DataFrame:
    """Rates per token; the share is the percentage of rows that contain the token."""
    cells = token_cells(df, field, (), flag, known, delimiter)
    rows = cells.agg(cell_rows()).scalar()
    return _containing(cells).select("token", *_token_measures(rows))


def token_rate_by_period(
    df: DataFrame,
    field: str,
    flag: str = "flag",
    period: str = "period",
    known: Sequence[str] | None = None,
    delimiter: str = ";",
) -> DataFrame:
    cells = token_cells(df, field, [period], flag, known, delimiter)
    rows = cells.groupBy(period).agg(cell_rows().alias("period_rows"))
    return (
        _containing(cells).join(rows, period).select(period, "token", *_token_measures("period_rows"))
    )


def token_list(df: DataFrame, field: str, known: Sequence[str], delimiter: str = ";") -> DataFrame:
    """Tokens seen, each with the remark whether it was expected, in name order."""
    return (
        explode_tokens(df, field, [], None, delimiter)
        .distinct()
        .select("token", F.col("token").isin(*known).alias("expected"))
        .orderBy("token")
    )


def token_indicators(
    df: DataFrame, field: str, columns: Mapping[str, str], delimiter: str = ";"
) -> DataFrame:
    """A 0/1 column per token, computed in the projection: no join and no shuffle."""
    tokens = token_array(field, delimiter)
    return df.withColumns(
        {
            name: F.coalesce(F.array_contains(tokens, label), F.lit(False)).cast("int")
            for label, name in columns.items()
        }
    )

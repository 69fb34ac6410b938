"""Date and time column expressions (D-01..D-07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlens.operators.joins import with_group_row

# The three report date layouts tried in this order.
REPORT_DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")


def parse_first_matching(c: Column, formats: Sequence[str] = REPORT_DATE_FORMATS) -> Column:
    """Per-value parse: the first format that parses this value (D-01, per-value mode)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def convert_date_format(
    df: DataFrame,
    column: str,
    formats: Sequence[str] = REPORT_DATE_FORMATS,
    out: str | None = None,
    group_by: Sequence[str] = (),
) -> DataFrame:
    """D-01 all-or-nothing parse: use the first format that parses *every* non-null value
    of the column (per group, e.g. per source file); if none does, the result is null.

    One small aggregate decides the format per group (a partial + final aggregation over
    ``len(formats)`` booleans); the answer is joined back, it holds one row
    per group.
    """
    out = out or column
    c = F.col(column)
    flags = [
        F.bool_and(c.isNull() | F.try_to_timestamp(c, F.lit(f)).isNotNull()).alias(f"__ok{i}")
        for i, f in enumerate(formats)
    ]
    decision = df.groupBy(*group_by).agg(*flags) if group_by else df.agg(*flags)
    chosen = F.lit(None).cast("timestamp")
    for i in reversed(range(len(formats))):
        chosen = F.when(F.col(f"__ok{i}"), F.try_to_timestamp(c, F.lit(formats[i]))).otherwise(chosen)
    if group_by:
        joined = with_group_row(df, decision, list(group_by), column, "left")
    else:
        joined = _attach_one_row(df, decision)
    return joined.withColumn(out, chosen).drop(*[f"__ok{i}" for i in range(len(formats))])


def _attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries (no join)."""
    cols = [one_row.select(c).scalar().alias(c) for c in one_row.columns]
    return df.select("*", *cols)


def elapsed_days(start: Column, end: Column) -> Column:
    """D-03: (end - start) in days as a double, from seconds / 86400."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(86400.0)


def week_sunday_first(d: Column) -> Column:
    """D-05: week of year with Sunday-first weeks, days before the first Sunday in week 0
    (range 0-53). Equals DuckDB strftime('%U')."""
    return F.floor((F.dayofyear(d) + F.lit(6) - (F.dayofweek(d) - F.lit(1))) / F.lit(7)).cast("bigint")


def is_weekend(d: Column) -> Column:
    """D-06: 1 when the weekday (Monday = 0) is above 4, else 0."""
    return (F.weekday(d) > 4).cast("int")


def day_of_week_monday0(d: Column) -> Column:
    """D-07: day of week with Monday = 0 .. Sunday = 6."""
    return F.weekday(d)

"""Aggregation operators (A-01..A-33).

All are hash aggregations with map-side partial aggregation, so a hot key (one district
holding a third of the reports) is reduced inside each map task before the shuffle.
Two counting modes exist:
  * SQL mode (``count(*)``, null keys kept as a group)
  * frame mode: count of non-null values of one column, groups with a null key dropped
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlens.operators.joins import lookup_divide


def count_by(
    df: DataFrame,
    keys: Sequence[str | Column],
    name: str = "count",
    count_col: str | None = None,
    drop_null_keys: bool = False,
) -> DataFrame:
    """A-01..A-16 core: group count.

    ``count_col`` given -> count of its non-null values (frame mode); ``drop_null_keys``
    removes groups whose key is null, as a frame ``groupby`` does.
    """
    agg = F.count(count_col).alias(name) if count_col else F.count(F.lit(1)).alias(name)
    out = df.groupBy(*keys).agg(agg)
    if drop_null_keys and keys:
        cond = F.lit(True)
        for k in out.columns[: len(keys)]:
            cond = cond & F.col(k).isNotNull()
        out = out.where(cond)
    return out


def daily_count(df: DataFrame, date_col: str = "date_input", name: str = "count") -> DataFrame:
    """A-01: reports per day."""
    return df.groupBy(F.to_date(date_col).alias("date")).agg(F.count(F.lit(1)).alias(name))


def count_per_area(
    counts: DataFrame,
    areas: DataFrame,
    key: str,
    area_col: str,
    count_col: str = "count",
    out: str = "count_per_km2",
) -> DataFrame:
    """A-03/A-04: counts divided by the mean area of the key (J-04 lookup-divide)."""
    return lookup_divide(counts, areas, key, count_col, area_col, out)


def share_of_total(df: DataFrame, value: str = "count", out: str = "share_pct") -> DataFrame:
    """A-17: value / total * 100. ``df`` is a grouped result: the total is a window over it, so
    that the facts are read once."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(out, F.col(value) / total * F.lit(100.0))


def avg_of_group_counts(
    df: DataFrame, outer: Sequence[Column | str], inner: Sequence[Column | str], name: str = "avg_count"
) -> DataFrame:
    """A-12: two-level aggregate: count per (outer + inner) group, then average per outer."""
    first = df.groupBy(*outer, *inner).agg(F.count(F.lit(1)).alias("__n"))
    keys = first.columns[: len(outer)]
    return first.groupBy(*keys).agg(F.avg("__n").alias(name))


def pivot_count(
    df: DataFrame,
    index: str | Sequence[str],
    pivot: str,
    values: Sequence | None = None,
    count_col: str | None = None,
    fill: int | None = 0,
) -> DataFrame:
    """A-23/M-22: pivot counts; explicit ``values`` avoid a distinct pass over the data."""
    idx = [index] if isinstance(index, str) else list(index)
    g = df.groupBy(*idx).pivot(pivot, list(values) if values is not None else None)
    out = g.agg(F.count(count_col) if count_col else F.count(F.lit(1)))
    if fill is not None:
        out = out.fillna(fill)
    return out


def margin_count(
    df: DataFrame,
    index: str,
    count_col: str,
    complete_rows: bool = True,
    name: str = "All",
) -> DataFrame:
    """A-18 (pivot with margins, only the margin column kept).

    ``complete_rows=True`` counts only rows without a null in any column (the parity
    rule of a frame pivot table with margins, Q-06); otherwise all rows with a key.
    """
    src = df.dropna("any") if complete_rows else df.where(F.col(index).isNotNull())
    return src.groupBy(index).agg(F.count(count_col).alias(name))


def two_stage_sum(
    df: DataFrame, first_keys: Sequence[str], final_keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """A-19: sum by first keys, then sum those sums by the final keys."""
    s1 = df.groupBy(*first_keys).agg(*[F.sum(v).alias(v) for v in values])
    return s1.groupBy(*final_keys).agg(*[F.sum(v).alias(v) for v in values])


def sum_by(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A-20/A-24: plain sums per key."""
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def mean_by(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A-21: plain means per key."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def roll_up_rows(
    df: DataFrame,
    key: str,
    members: Sequence,
    new_key,
    sums: Sequence[str],
    ratios: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """A-22: sum the ``members`` rows into one new row keyed ``new_key``, recompute the
    ratio columns (name -> (numerator, denominator)) for it, append it to the input."""
    ratios = ratios or {}
    merged = df.where(F.col(key).isin(list(members))).agg(*[F.sum(c).alias(c) for c in sums])
    merged = merged.withColumn(key, F.lit(new_key).cast(df.schema[key].dataType))
    for name, (num, den) in ratios.items():
        merged = merged.withColumn(name, F.try_divide(F.col(num), F.col(den)))
    return df.unionByName(merged, allowMissingColumns=True)


def median_of(df: DataFrame, col: str, keys: Sequence[str] = (), skip_null: bool = True, name: str = "median") -> DataFrame:
    """A-25: exact median. ``skip_null=False`` gives null as soon as one value is null/NaN
    (numpy parity)."""
    from civlens.operators.ranking import exact_median

    med = exact_median(df, col, keys, name)
    if skip_null:
        return med
    c = F.col(col)
    bad = df.groupBy(*keys).agg((F.sum(F.when(c.isNull() | F.isnan(c), 1).otherwise(0)) > 0).alias("__bad"))
    if keys:
        out = bad.join(med, list(keys), "left")
    else:
        out = bad.withColumn(name, med.select(name).scalar())
    return out.select(*keys, F.when(F.col("__bad"), F.lit(None)).otherwise(F.col(name)).alias(name))


def value_counts(df: DataFrame, col: str, by: Sequence[str] = (), pct: bool = False) -> DataFrame:
    """A-26/M-25: count per value (null values dropped, as in a frame value count), with
    the share within ``by`` in percent when ``pct``: a window over the grouped counts."""
    base = df.where(F.col(col).isNotNull())
    counts = base.groupBy(*by, col).agg(F.count(F.lit(1)).alias("count"))
    if not pct:
        return counts
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("pct", F.col("count") / total * F.lit(100.0))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """A-28: number of rows minus number of distinct keys (null counted as one value)."""
    has_null = F.max(F.col(key).isNull().cast("bigint"))
    return df.agg((F.count(F.lit(1)) - F.count_distinct(key) - has_null).alias("n_duplicates"))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-32."""
    return df.select(*cols).distinct()


def pivot_years_with_total(
    df: DataFrame, keys: Sequence[str], year_col: str, years: Sequence[int]
) -> DataFrame:
    """A-33: counts of keys x year for the ``years`` that become columns, ``other_years`` for all
    other rows, a Total of all rows, and the share of each key row within its first key. One
    grouped count; the share is a window over it."""
    year = F.col(year_col)
    p = df.groupBy(*keys).agg(
        *[F.count_if(year == y).alias(str(y)) for y in years],
        F.count_if(~F.coalesce(year.isin(list(years)), F.lit(False))).alias("other_years"),
        F.count(F.lit(1)).alias("Total"),
    )
    total = F.sum("Total").over(Window.partitionBy(keys[0]))
    return p.withColumn("share_in_category", F.col("Total") / total * F.lit(100.0))

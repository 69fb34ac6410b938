"""Window, dedup, ordering and set operators (W-01..W-11, U-01..U-03).

Rules used here:
  * a window without ``partitionBy`` runs in one task, so it is applied only to grouped
    results whose size is bounded by the calendar (years, months, days x districts);
  * per-key choices over raw rows (dedup, top-1) are ``row_number() == 1`` windows, which Spark
    also limits per key before the shuffle (WindowGroupLimit), so that a hot key sends one
    row a task;
  * duplicate flags come from a grouped count joined back, for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lag_change(
    df: DataFrame,
    order_by: Sequence[str],
    value: str = "count",
    prev_name: str = "count_previous",
    pct_name: str | None = "perc_diff",
) -> DataFrame:
    """W-01..W-03: previous row's value in ``order_by`` order and the % change.

    ``df`` is a grouped result (one row per calendar key), so one ordered window is fine.
    """
    w = Window.orderBy(*order_by)
    out = df.withColumn(prev_name, F.lag(value).over(w))
    if pct_name:
        out = out.withColumn(
            pct_name, F.try_divide(F.col(value) - F.col(prev_name), F.col(prev_name)) * F.lit(100.0)
        )
    return out


def top_value_per_group(
    counts: DataFrame,
    keys: Sequence[str],
    value_col: str,
    count_col: str = "count",
    out: str = "top_category",
) -> DataFrame:
    """W-04: the value with the highest count in each group, on each of the group's rows.

    Ties are broken by the smallest value (Q-10). ``counts`` is a grouped result, so one window
    over it reads the facts once.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(count_col).desc(), F.col(value_col))
    return counts.withColumn(out, F.first(value_col).over(w))


def lead_features(
    df: DataFrame,
    target: str,
    window_length: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    prefix: str = "f",
) -> DataFrame:
    """W-05: ``f_i = lead(target, i)`` for i = 1..L-1 and ``f_0 = lead(target, L)``;
    rows with a missing lead are dropped.

    With ``partition_by`` the leads stay inside each series (our default); without it they run over
    the whole ordered table (parity with Q-12), range by range: see ``global_leads``.
    """
    steps = {f"{prefix}_{i}": i for i in range(1, window_length)} | {f"{prefix}_0": window_length}
    if not partition_by:
        return global_leads(df, target, steps, order_by).dropna(subset=list(steps))
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.select("*", *[F.lead(target, i).over(w).alias(name) for name, i in steps.items()]).dropna(subset=list(steps))


def _as_number(c: Column, kind: T.DataType) -> Column:
    """A number that grows with a numeric, date or timestamp column (nulls first, like the order)."""
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, T.TimestampNTZType):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"order first by a number, date or timestamp, not by {kind.simpleString()}")
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def global_leads(df: DataFrame, target: str, steps: dict[str, int], order_by: Sequence[str], ranges: int = 256) -> DataFrame:
    """Leads of ``target`` by ``steps`` (name -> rows ahead) over the whole table in the order of
    ``order_by``, without a window over all rows.

    The table is cut into ranges of the first order column (number, date or timestamp) of about equal
    size; rows of one value stay together, so that column should have many values. Each range lends
    its first rows to those before it that need them: a range of fewer rows than the longest lead
    lets its neighbours ask further on, so ranges may be tiny or empty. Windows then run within a
    range and what it has borrowed. Ranges, their sizes and the cuts are part of one lazy plan. Ties in
    ``order_by`` are ordered arbitrarily, as by any window.
    """
    reach = max(steps.values())
    by = df.withColumn("__v", _as_number(F.col(f"`{order_by[0]}`"), df.schema[order_by[0]].dataType))
    cuts = by.agg(F.percentile_approx("__v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(20 * ranges))).scalar()
    # one row's arrays as columns: at most ``ranges`` numbers
    dealt = by.withColumn("__cuts", F.array_distinct(cuts))
    number = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))), F.lit(0))
    dealt = dealt.withColumn("__range", number).drop("__v", "__cuts")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    held = sizes.agg(F.collect_list(F.struct(F.col("__range").alias("r"), "n")).alias("held"))
    below = held.select(  # rows of the ranges under r, for r = 0 .. ranges
        F.transform(
            F.sequence(F.lit(0), F.lit(ranges)),
            lambda r: F.aggregate(F.filter("held", lambda q: q["r"] < r), F.lit(0).cast("long"), lambda total, q: total + q["n"]),
        )
    ).scalar()
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order_by))
    placed = dealt.withColumn("__place", place).withColumn("__below", below)
    # range p borrows a row if fewer than ``reach`` rows stand between the end of p and the row
    before = lambda p: F.element_at("__below", F.col("__range") + 1) - F.element_at("__below", p + 2) + F.col("__place") - 1
    none = F.array().cast("array<int>")
    earlier = F.when(
        (F.col("__place") <= reach) & (F.col("__range") > 0),
        F.filter(F.sequence(F.lit(0), F.col("__range") - 1), lambda p: before(p) < reach),
    ).otherwise(none)
    lent = placed.withColumn("__to", F.explode(F.concat(F.array("__range"), earlier))).drop("__below")
    w = Window.partitionBy("__to").orderBy("__range", "__place")
    led = lent.select("*", *[F.lead(target, i).over(w).alias(name) for name, i in steps.items()])
    return led.where("__to = __range").drop("__to", "__range", "__place")


def dedup_keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """W-06: one row per key, the one with the largest ``seq`` (the last in source order).

    Each map task keeps one row of a key before the shuffle (WindowGroupLimit).
    """
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    columns = [key, *[c for c in df.columns if c != key]]
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*columns)


def mark_duplicates(df: DataFrame, keys: Sequence[str], out: str = "is_dup") -> DataFrame:
    """W-07: flag every row whose key occurs more than once (keep=False)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    flagged = df.join(counts, on=list(keys), how="left")
    return flagged.withColumn(out, F.col("__n").isNotNull()).drop("__n")


def choose_version(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    cutoff: str,
    keep_all: bool = False,
) -> DataFrame:
    """W-08: among rows sharing ``key``: when some rows ended before ``cutoff`` drop
    those; otherwise keep the row with the earliest start, one of equal ones (the first by its
    other columns). ``keep_all`` reproduces Q-15 (nothing dropped)."""
    if keep_all:
        return df
    rest = [c for c in df.columns if c not in (key, start)]
    row = F.struct(F.col(start).isNull().alias("__none"), start, *rest)
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max((F.col(end) < F.lit(cutoff).cast("date")).cast("int")).alias("__any_ended"),
        F.min(row).alias("__first"),
    )
    j = df.join(stats, on=key, how="inner")
    ended = F.coalesce(F.col(end) < F.lit(cutoff).cast("date"), F.lit(False))
    keep = (F.col("__n") == 1) | (
        F.when(F.col("__any_ended") == 1, ~ended).otherwise(row.eqNullSafe(F.col("__first")))
    )
    return j.where(keep).drop("__n", "__any_ended", "__first")


def top1_by(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str], desc: bool = True) -> DataFrame:
    """W-10: first row per group after sorting by ``order_col``."""
    order = F.col(order_col).desc() if desc else F.col(order_col).asc()
    names = list(dict.fromkeys([*keys, *value_cols]))
    if not keys:
        return df.orderBy(order).select(*names).limit(1)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*names)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """U-01/U-02: UNION ALL by column name; missing columns padded with nulls."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def primary_key_violations(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """U-03: keys that occur more than once (empty when the key is a primary key)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def ordered(df: DataFrame, col: str | Column, desc: bool = False) -> DataFrame:
    """W-09."""
    c = F.col(col) if isinstance(col, str) else col
    return df.orderBy(c.desc() if desc else c.asc())

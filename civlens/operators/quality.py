"""Data-quality and profiling operators (A-27..A-31, S-12, U-03).

Each profile is one aggregation pass over the data (per-column expressions inside a single
``agg``), then a reshape of its one-row result -- no per-column jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlens.operators.ranking import quantiles_of


def _stack(one_row: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "column") -> DataFrame:
    """Reshape a one-row frame holding ``{place}__{field}`` columns, by the place of a name in
    ``names``, into one row per name. Names may hold any character."""
    rows = [
        F.struct(F.lit(n).alias(key), *[F.col(f"{k}__{f}").alias(f) for f in fields]) for k, n in enumerate(names)
    ]
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A-27: null count and null percentage per column (NaN counts as null, as in pandas)."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for k, c in enumerate(cols):
        miss = _col(c).isNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            miss = miss | F.isnan(_col(c))
        aggs.append(F.sum(miss.cast("bigint")).alias(f"{k}__n_null"))
    one = df.agg(*aggs)
    for k in range(len(cols)):
        one = one.withColumn(f"{k}__pct_null", F.col(f"{k}__n_null") / F.col("__rows") * F.lit(100.0))
    return _stack(one, cols, ["n_null", "pct_null"])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A-29: count, mean, sample std, min, quartiles (exact, interpolated) and max per column: one
    pass for the moments, one for the quartiles of all columns."""
    makers = {"count": F.count, "mean": F.avg, "std": F.stddev_samp}
    makers |= {"min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    aggs = [make(_col(c)).alias(f"{k}__{f}") for k, c in enumerate(columns) for f, make in makers.items()]
    stats = _stack(df.agg(*aggs), columns, list(makers))
    quartiles = quantiles_of(df, columns, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return stats.join(quartiles, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def iqr_outliers(df: DataFrame, features: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """A-30: rows beyond q25 - 1.5 IQR or q75 + 1.5 IQR of a feature; a row is repeated
    once per feature it is an outlier on, with ``Outlier`` = that feature's name.

    The bounds of all features come from one pass of exact quantiles, turned into one row and attached
    as a scalar subquery: the rows are neither joined nor shuffled.
    """
    bounds = quantiles_of(df, features, [0.25, 0.75], ["q25", "q75"])
    span = (F.col("q75") - F.col("q25")) * 1.5
    of = lambda k, bound: F.max(F.when(F.col("column") == features[k], bound))
    fences = [F.struct(of(k, F.col("q25") - span).alias("lo"), of(k, F.col("q75") + span).alias("hi")) for k in range(len(features))]
    pairs = [
        F.struct(F.lit(f).alias("f"), _col(f).cast("double").alias("v"), F.get("__fences", F.lit(k)).alias("fence"))
        for k, f in enumerate(features)
    ]
    long = df.withColumn("__fences", bounds.agg(F.array(*fences)).scalar()).withColumn("__p", F.explode(F.array(*pairs)))
    out = long.where("__p.v < __p.fence.lo or __p.v > __p.fence.hi").withColumn("Outlier", F.col("__p.f"))
    return out.drop("__p", "__fences")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A-31: Pearson correlation of every pair (long form), one aggregation pass,
    rows with a null in any of the columns left out (as a dropna before the matrix)."""
    clean = df.dropna(subset=list(columns))
    pairs = [(a, b) for a in columns for b in columns]
    one = clean.agg(*[F.corr(_col(a), _col(b)).alias(str(k)) for k, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(str(k)).alias("corr"))
        for k, (a, b) in enumerate(pairs)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Value patterns accepted by the type inference (order-free, Q-20 decision).
INT_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT_PATTERN = (r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][+-]?\d+(_\d+)*)?|\d+(_\d+)*\.([eE][+-]?\d+)?"
                 r"|(?i:nan|inf|infinity))\s*$")


def _type_flags(c: Column, name: int) -> list[Column]:
    s = c.cast("string")
    present = s.isNotNull()
    return [
        F.bool_and(~present | s.rlike(INT_PATTERN)).alias(f"{name}__is_int"),
        F.bool_and(~present | s.rlike(FLOAT_PATTERN)).alias(f"{name}__is_float"),
        F.bool_and(~present | F.try_parse_json(s).isNotNull()).alias(f"{name}__is_json"),
        F.max(F.length(s)).alias(f"{name}__max_len"),
    ]


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """S-12: per column the first of INT, FLOAT, JSON, VARCHAR(max length) accepting every
    non-null value (as text), from one aggregation pass over all columns."""
    cols = list(columns or df.columns)
    aggs = []
    for k, c in enumerate(cols):
        aggs += _type_flags(_col(c), k)
    one = df.agg(*aggs)
    st = _stack(one, cols, ["is_int", "is_float", "is_json", "max_len"])
    sql_type = (
        F.when(F.col("is_int"), F.lit("INT"))
        .when(F.col("is_float"), F.lit("FLOAT"))
        .when(F.col("is_json"), F.lit("JSON"))
        .otherwise(F.concat(F.lit("VARCHAR("), F.coalesce(F.col("max_len"), F.lit(0)).cast("string"), F.lit(")")))
    )
    return st.select("column", sql_type.alias("sql_type"), F.col("max_len").cast("bigint").alias("max_len"))

"""Quality and profile jobs (A-27, A-29, A-30, A-31, S-12) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlens.operators import quality as Q
from civlens.plans.catalog import register
from civlens.sources import tables

rt = tables.read_table


def _doc_labels(spark, d):
    doc = rt(spark, d, "documents")
    return doc.join(rt(spark, d, "labels"), "doc_id", "left")


_NULL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@register("a27_null_profile", "WITH t AS (SELECT d.*, l.quality, l.toxic FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id)\n" + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_null, "
              f"round((COUNT(*) - COUNT({c})) / COUNT(*) * 100.0, 6) AS pct_null FROM t" for c in _NULL_COLS))
def a27_null_profile(spark, d):
    """A-27: null count and percentage per column, one pass."""
    return Q.null_profile(_doc_labels(spark, d), _NULL_COLS)


# All numeric columns of the table.
_DESC_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a29_describe", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, round(AVG({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(MIN({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
       round(quantile_cont({c}, 0.75), 6) AS q75, round(MAX({c}), 6) AS max FROM lineitem""" for c in _DESC_COLS))
def a29_describe(spark, d):
    """A-29: numeric profile with exact interpolated quartiles."""
    return Q.describe(rt(spark, d, "lineitem"), _DESC_COLS)


# All numeric columns of the table.
_OUT_FEATURES = ["event_id", "user_id", "value"]


@register("a30_iqr_outliers", "\nUNION ALL\n".join(
    f"""SELECT e.event_id, '{f}' AS "Outlier" FROM events e,
       (SELECT quantile_cont({f}, 0.25) AS q25, quantile_cont({f}, 0.75) AS q75 FROM events) q
     WHERE e.{f} < q.q25 - 1.5 * (q.q75 - q.q25) OR e.{f} > q.q75 + 1.5 * (q.q75 - q.q25)""" for f in _OUT_FEATURES))
def a30_iqr_outliers(spark, d):
    """A-30: rows outside the 1.5 IQR fences, one row per (row, feature)."""
    e = rt(spark, d, "events")
    return Q.iqr_outliers(e, _OUT_FEATURES).select("event_id", "Outlier")


@register("a31_correlation_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _DESC_COLS for b in _DESC_COLS))
def a31_correlation_matrix(spark, d):
    """A-31: Pearson correlation matrix in long form."""
    return Q.correlation_matrix(rt(spark, d, "lineitem"), _DESC_COLS)


_TYPE_SOURCES = [("events", "props"), ("lineitem", "l_quantity"), ("orders", "o_custkey"), ("part", "p_brand")]


def _type_sql(table, col):
    s = f"CAST({col} AS VARCHAR)"
    return f"""SELECT '{col}' AS "column",
  CASE WHEN bool_and({s} IS NULL OR regexp_matches({s}, '{Q.INT_PATTERN}')) THEN 'INT'
       WHEN bool_and({s} IS NULL OR regexp_matches({s}, '{Q.FLOAT_PATTERN}')) THEN 'FLOAT'
       WHEN bool_and({s} IS NULL OR json_valid({s})) THEN 'JSON'
       ELSE 'VARCHAR(' || CAST(coalesce(MAX(length({s})), 0) AS VARCHAR) || ')' END AS sql_type,
  CAST(MAX(length({s})) AS BIGINT) AS max_len
FROM {table}"""


@register("s12_infer_types", "\nUNION ALL\n".join(_type_sql(t, c) for t, c in _TYPE_SOURCES))
def s12_infer_types(spark, d):
    """S-12: order-free SQL type of text columns (INT, FLOAT, JSON, VARCHAR(n))."""
    out = None
    for t, c in _TYPE_SOURCES:
        col = rt(spark, d, t).select(F.col(c).cast("string").alias(c))
        prof = Q.infer_types(col, [c])
        out = prof if out is None else out.unionByName(prof)
    return out

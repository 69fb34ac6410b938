"""Query catalog: every registered job, with its DuckDB oracle SQL when SQL can say it.

A query is ``fn(spark, sf_dir) -> DataFrame``. ``present`` fixes the output types so the
Spark result and the oracle compare value by value: integers as BIGINT, doubles rounded
to 6 places, dates as 'yyyy-MM-dd' text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DESCRIPTIONS: dict[str, str] = {}


def register(name: str, sql: str | None = None, doc: str = ""):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DESCRIPTIONS[name] = doc or ((fn.__doc__ or "").strip().splitlines() or [""])[0]
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import the query modules so they register themselves."""
    from civlens.plans import (  # noqa: F401
        report_queries,
        scalar_queries,
        spatial_queries,
        quality_queries,
        model_queries,
        cleaning_queries,
    )

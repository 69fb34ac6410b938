"""Join operators (J-01..J-12).

Every join here is a plain equi join without hints: Spark broadcasts a side only below its own
byte threshold, re-plans at run time (AQE) and splits skewed partitions. Building a query runs
no job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_dim(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
) -> DataFrame:
    """J-01/J-02/J-03/J-05/J-07: fact left join a dimension on shared key names."""
    return fact.join(dim, on=on, how=how)


def chain_left_joins(base: DataFrame, dims: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """J-05: successive left joins building a feature table keyed by ``on``."""
    out = base
    for d in dims:
        out = left_join_dim(out, d, on)
    return out


def lookup_divide(
    fact: DataFrame,
    lookup: DataFrame,
    key: str,
    numerator: str,
    denominator: str,
    out: str,
) -> DataFrame:
    """J-04: divide a fact column by the mean of the lookup rows sharing its key.

    No match, or a zero mean, gives null (the reference gives NaN).
    """
    means = lookup.groupBy(key).agg(F.avg(denominator).alias("__den"))
    joined = fact.join(means, on=key, how="left")
    return joined.withColumn(out, F.try_divide(F.col(numerator), F.col("__den"))).drop("__den")


#: Keys over which the rows of one group are dealt where a group's row is looked up.
GROUP_SALTS = 256


def with_group_row(df: DataFrame, rows: DataFrame, group: Sequence[str], spread: str, how: str = "inner") -> DataFrame:
    """``df`` with the columns of the one row that ``rows`` has for its group. A group may hold any
    share of ``df``: its rows are dealt by a hash of the column ``spread`` over GROUP_SALTS keys, on
    each of which the group's row stands, so no task gets a whole group."""
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(GROUP_SALTS)).cast("int"))
    copies = rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(GROUP_SALTS - 1))))
    return dealt.join(copies, [*group, "__salt"], how).drop("__salt")

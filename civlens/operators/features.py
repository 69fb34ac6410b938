"""Feature engineering operators (M-01..M-06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordinal_encode(df: DataFrame, col: str, out: str | None = None):
    """M-01: sorted categories -> 0..n-1 (``StringIndexer``, alphabetical). Returns the
    fitted model (persist it with ``model.write().save(path)``) and the encoded frame."""
    out = out or f"{col}_code"
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error").fit(df)
    return model, model.transform(df).withColumn(out, F.col(out).cast("int"))


def one_hot_drop_first(df: DataFrame, col: str, levels: Sequence, prefix: str | None = None) -> DataFrame:
    """M-02: one 0/1 column per level except the first, named ``{prefix}_{level}``. The caller
    states the levels (the schema depends on them); another value gives zeros, as the first does."""
    prefix = prefix or col
    cols = [(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in list(levels)[1:]]
    return df.select("*", *cols)


def per_area(df: DataFrame, cols: Sequence[str], area: str, suffix: str = "_p_km2") -> DataFrame:
    """M-03: ``x_p_km2 = x / area`` (null when the area is zero or missing)."""
    return df.select("*", *[F.try_divide(F.col(c), F.col(area)).alias(f"{c}{suffix}") for c in cols])


def membership_flag(base: DataFrame, members: DataFrame, key: str, out: str = "zti") -> DataFrame:
    """M-04: 1 when the key occurs in ``members``, else 0 (left join on distinct keys)."""
    m = members.select(key).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(1))
    return base.join(m, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))

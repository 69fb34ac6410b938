"""Projection and filter operators (P-01..P-17). All are narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Report bounding boxes (lon_min, lat_min, lon_max, lat_max).
DEFAULT_BBOX = (2.219067, 48.812629, 2.421112, 48.905464)
CITY_BBOX = (2.220268, 48.812799, 2.473640, 48.903715)


def lower_columns(df: DataFrame) -> DataFrame:
    """P-01."""
    return df.toDF(*[c.lower() for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str], strip: bool = False) -> DataFrame:
    """P-02: rename by mapping (missing names ignored); ``strip`` trims every name first."""
    if strip:
        df = df.toDF(*[c.strip() for c in df.columns])
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    """P-03 (``drop`` ignores missing names)."""
    return df.drop(*names)


def pad_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """P-05: add the missing columns of ``schema`` as typed nulls and order as the schema."""
    out = df
    for f in schema.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def inside_bbox(lon: Column, lat: Column, bbox: Sequence[float] = DEFAULT_BBOX, keep_null: bool = True) -> Column:
    """P-06: inclusive bounding-box predicate. With ``keep_null`` a null or NaN coordinate
    passes (Q-03: both comparisons are false for a missing value)."""
    x0, y0, x1, y1 = bbox
    lon_n = F.nanvl(lon, F.lit(None).cast("double"))
    lat_n = F.nanvl(lat, F.lit(None).cast("double"))
    outside = (lat_n < y0) | (lat_n > y1) | (lon_n < x0) | (lon_n > x1)
    if keep_null:
        return ~F.coalesce(outside, F.lit(False))
    return F.coalesce(~outside, F.lit(False))


def bbox_filter(df: DataFrame, bbox: Sequence[float] = DEFAULT_BBOX, lon: str = "lon", lat: str = "lat",
                keep_null: bool = True) -> DataFrame:
    return df.where(inside_bbox(F.col(lon), F.col(lat), bbox, keep_null))


def not_equal_keep_null(df: DataFrame, col: str, value) -> DataFrame:
    """P-07: rows whose value differs from ``value``; null values are kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def not_null(df: DataFrame, col: str) -> DataFrame:
    """P-08."""
    return df.where(F.col(col).isNotNull())


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P-09 / P-10 (Spark's ``dropna`` also drops NaN in float columns)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def fill_zero(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P-11."""
    return df.fillna(0, subset=list(subset) if subset else None)


def split_lat_lon(c: Column, sep: str = ",") -> Column:
    """P-15: "lat,lon" text -> struct(lat, lon) doubles (null when not numeric)."""
    parts = F.split(c, sep)
    return F.struct(
        F.trim(F.get(parts, 0)).try_cast("double").alias("lat"),
        F.trim(F.get(parts, 1)).try_cast("double").alias("lon"),
    )


def columns_by_type(df: DataFrame, kinds: tuple = (T.FloatType, T.DoubleType)) -> tuple[list[str], list[str]]:
    """P-16: split column names into (matching kinds, the rest) at plan time."""
    hit = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return hit, [c for c in df.columns if c not in hit]


def relabel_rare(y: Column, other: int = 9) -> Column:
    """P-17: ``(y == 2) or (y > 3 and y != 8)`` -> 9; 0, 1, 3 and 8 are kept."""
    rare = (y == 2) | ((y > 3) & (y != 8))
    return F.when(rare, F.lit(other)).otherwise(y)

"""Sinks (S-10, S-11, S-13..S-15, S-18, S-19).

Every sink is a distributed ``DataFrame.write``; nothing passes through the driver.
Credentials for a JDBC sink come from caller options only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """S-13: CSV with a header and no index column, one file per partition."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def sized(c: str, limit: int):
    """A text column that fails the query at a value longer than ``limit``."""
    told = F.concat(F.lit(f"{c}: longer than {limit}: "), F.length(c).cast("string"))
    return F.when(F.length(c) > limit, F.raise_error(told).cast("string")).otherwise(F.col(c)).alias(c)


def write_typed_table(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    partition_by: Sequence[str] = ("year",),
    varchar_limits: Mapping[str, int] | None = None,
    mode: str = "overwrite",
) -> None:
    """S-14: cast to the target schema, check text sizes in the same pass, write Parquet partitioned by
    year with dynamic partition overwrite (only the written years are replaced)."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [c for c in partition_by if c not in schema.fieldNames()]
    typed = df.select(*cols, *extra)
    limits = varchar_limits or {}
    typed = typed.select(*[sized(c, limits[c]) if c in limits else F.col(c) for c in typed.columns])
    (typed.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def write_new_table(df: DataFrame, path: str) -> None:
    """S-15: fail when the target already exists."""
    df.write.mode("errorifexists").parquet(path)


def write_osm(df: DataFrame, path_with_geometry: str, path_without_geometry: str) -> None:
    """S-10 / S-11: the same rows twice, with and without the geometry column."""
    write_csv(df, path_with_geometry)
    write_csv(df.drop("geometry"), path_without_geometry)


def write_jdbc(df: DataFrame, url: str, table: str, options: Mapping[str, str], mode: str = "overwrite",
               batchsize: int = 100) -> None:
    """S-11 (optional JDBC target): batched inserts; user, password and driver come from
    ``options`` supplied by the caller."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize)
    for k, v in options.items():
        w = w.option(k, v)
    w.mode(mode).save()


def write_geojson_features(df: DataFrame, geometry_json: str, properties: Sequence[str], path: str) -> None:
    """S-18: newline-delimited GeoJSON features (one Feature per line)."""
    feat = F.concat(
        F.lit('{"type": "Feature", "properties": '),
        F.to_json(F.struct(*properties)),
        F.lit(', "geometry": '),
        F.col(geometry_json),
        F.lit("}"),
    )
    df.select(feat.alias("value")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """S-19: evaluation tables (per-class AUC, scores, parameters) as JSON lines, each to
    its own path (Q-30)."""
    df.write.mode("overwrite").json(path)

"""End-to-end cleaning of raw yearly report files as one lazy plan:

read -> standardise names -> parse dates (layout chosen per file) -> dedup (keep last)
-> bounding-box filter -> district assignment (grid join) -> sub-category split,
category translation, schema alignment -> fuzzy sub-category correction -> typed,
year-partitioned write. Shuffles: dedup on ``id_dmr``, the spatial cell join, the
distinct-pair fuzzy join and its join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlens.functions import dates, text
from civlens.operators import columns as P
from civlens.operators import spatial as S
from civlens.operators import windows as W
from civlens.operators.fuzzy_correct import correct_subcategories

# Canonical cleaned-report schema (column order of the cleaned tables).
CLEAN_SCHEMA = T.StructType([
    T.StructField("id_dmr", T.StringType()), T.StructField("category_FR", T.StringType()),
    T.StructField("adresse", T.StringType()), T.StructField("code_postal", T.StringType()),
    T.StructField("code_postal_id", T.StringType()), T.StructField("etat", T.StringType()),
    T.StructField("date_etat", T.DateType()), T.StructField("numero", T.IntegerType()),
    T.StructField("prefixe", T.StringType()), T.StructField("intervenant", T.StringType()),
    T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()),
    T.StructField("date_input", T.DateType()), T.StructField("quartier_id", T.StringType()),
    T.StructField("subcategory_FR", T.StringType()), T.StructField("extrainfo", T.StringType()),
    T.StructField("deltadays_signal_etat", T.DoubleType()), T.StructField("category_EN", T.StringType()),
])

RENAMES = {"x": "lon", "y": "lat", "arrondissement": "code_postal_id", "type": "category_FR"}


def standardise(raw: DataFrame) -> DataFrame:
    """P-01 / P-02 / P-03: lower-case names, role renames, unused columns dropped."""
    df = P.rename(P.lower_columns(raw), RENAMES)
    return P.drop_if_present(df, "oid_", "anneedecl", "moisdecl", "ville", "conseilquartier")


def parse_report_dates(df: DataFrame, file_col: str = "_file_name") -> DataFrame:
    """D-01 per source file, D-03 delay in days."""
    out = dates.convert_date_format(df, "datedecl", out="date_input_ts", group_by=[file_col])
    if "dateetat" in out.columns:
        out = dates.convert_date_format(out, "dateetat", out="date_etat_ts", group_by=[file_col])
    else:
        out = out.withColumn("date_etat_ts", F.lit(None).cast("timestamp"))
    out = out.withColumn("deltadays_signal_etat", dates.elapsed_days(F.col("date_input_ts"), F.col("date_etat_ts")))
    return out.withColumn("date_input", F.to_date("date_input_ts")).withColumn("date_etat", F.to_date("date_etat_ts"))


def clean_reports(
    raw: DataFrame,
    districts: DataFrame,
    official_subcategories: DataFrame,
    bbox: Sequence[float] = P.CITY_BBOX,
    cell: float = 0.005,
    seq: str = "_seq",
) -> DataFrame:
    """The cleaning plan. ``raw`` holds the raw columns plus ``_file_name`` and a source
    order column ``seq``; ``districts`` holds quartier_id, code_postal_id, geometry;
    ``official_subcategories`` holds category_FR, name_FR."""
    df = standardise(raw)
    df = parse_report_dates(df)
    df = W.dedup_keep_last(df, "id_dmr", seq)
    df = P.bbox_filter(df, bbox, keep_null=True)
    if "code_postal_id" not in df.columns:
        df = df.withColumn("code_postal_id", F.lit(None).cast("string"))
    df = S.assign_points(df, districts, ["quartier_id", "code_postal_id"], cell=cell, how="left")
    df = df.withColumn("quartier_id", F.col("poly_quartier_id").cast("string")).withColumn(
        "code_postal_id", F.coalesce(F.col("poly_code_postal_id").cast("string"), F.col("code_postal_id")))
    st = text.parse_soustype(F.col("soustype"))
    df = df.withColumn("subcategory_FR", st["main"]).withColumn("extrainfo", st["extra"])
    df = df.withColumn("category_FR", text.utrim(F.col("category_FR")))
    # a report without a district's postcode or without a category leaves the table
    df = df.where("code_postal_id is not null and category_FR is not null")
    df = df.withColumn("category_EN", text.translate_category(F.col("category_FR")))
    df = correct_subcategories(df, official_subcategories)
    return P.pad_columns(df, CLEAN_SCHEMA).withColumn("year", F.year("date_input"))

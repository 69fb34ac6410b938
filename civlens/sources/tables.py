"""Driver tables and the role views built on them.

The report analytics work on a "reports" fact (one row per citizen report) plus small
dimensions (district -> postcode). The driver ships TPC-H-like tables; the role views
below map them onto those roles with plain joins and column expressions, so every job
that reads a role view reads the whole driver tables and grows with them.

Role mapping (fixed):
  reports      orders ⋈ customer ⋈ nation: id_dmr = o_orderkey, date_input = o_orderdate,
               etat = o_orderstatus, category_FR = o_orderpriority,
               quartier_id = c_nationkey, code_postal_id = n_regionkey
  report_lines lineitem ⋈ part: one sub-category text "p_type : p_name" per line
  districts    nation: an L-shaped polygon per nation (unit square at (n % 5, n div 5)
               minus its upper-right quarter), postcode = n_regionkey
  shops        supplier: point per supplier, category by sign of s_acctbal
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def point_lon(key: Column) -> Column:
    """Deterministic longitude in [-0.2, 5.2] from an integer key (fixed role formula)."""
    return ((key * F.lit(7919)) % F.lit(100003) + F.lit(0.5)) / F.lit(100003.0) * F.lit(5.4) - F.lit(0.2)


def point_lat(key: Column) -> Column:
    return ((key * F.lit(104729)) % F.lit(100019) + F.lit(0.5)) / F.lit(100019.0) * F.lit(5.4) - F.lit(0.2)


def reports(spark: SparkSession, sf_dir: str, date_from: str | None = None) -> DataFrame:
    """Cleaned-report role: one row per order, keyed by ``id_dmr``.

    ``date_from`` ('yyyy-MM-dd') filters on the raw date column so the predicate reaches
    the Parquet scan (S-04).
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    )
    if date_from is not None:
        orders = orders.where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit(date_from)))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # customer is a large dimension at scale: a plain equi join, AQE picks the strategy.
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"
    )
    return joined.select(
        F.col("o_orderkey").alias("id_dmr"),
        F.to_date("o_orderdate").alias("date_input"),
        F.col("o_orderstatus").alias("etat"),
        F.col("o_orderpriority").alias("category_FR"),
        F.col("c_nationkey").cast("bigint").alias("quartier_id"),
        F.col("n_regionkey").cast("bigint").alias("code_postal_id"),
        point_lon(F.col("o_orderkey")).alias("lon"),
        point_lat(F.col("o_orderkey")).alias("lat"),
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report detail role: one row per line item with its sub-category text and dates."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        F.col("l_orderkey").alias("id_dmr"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.concat_ws(" : ", "p_type", "p_name").alias("soustype"),
        F.col("l_shipdate").alias("date_etat_ts"),
    )


# Fixed role geometry: L-shaped district ring built from the nation key.
def district_ring(n: Column) -> Column:
    x = (n % 5).cast("double")
    y = F.floor(n / 5).cast("double")

    def pt(dx: float, dy: float) -> Column:
        return F.struct((x + F.lit(dx)).alias("x"), (y + F.lit(dy)).alias("y"))

    return F.array(pt(0, 0), pt(1, 0), pt(1, 0.5), pt(0.5, 0.5), pt(0.5, 1), pt(0, 1), pt(0, 0))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District role: quartier_id, code_postal_id, name, geometry (multipolygon)."""
    nation = read_table(spark, sf_dir, "nation")
    return nation.select(
        F.col("n_nationkey").cast("bigint").alias("quartier_id"),
        F.col("n_regionkey").cast("bigint").alias("code_postal_id"),
        F.col("n_name").alias("name"),
        F.array(F.array(district_ring(F.col("n_nationkey")))).alias("geometry"),
    )


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop role (OSM-like rows): id_, lat, lon, category, subcategory, name."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id_"),
        point_lat(F.col("s_suppkey")).alias("lat"),
        point_lon(F.col("s_suppkey")).alias("lon"),
        F.when(F.col("s_acctbal") >= 0, F.lit("shop")).otherwise(F.lit("amenity")).alias("category"),
        F.col("s_nationkey").cast("bigint").alias("subcategory"),
        F.col("s_name").alias("name"),
    )


# --- SQL text of the same roles, for the DuckDB oracle -------------------------------

REPORTS_SQL = """
reports AS (
  SELECT o.o_orderkey AS id_dmr,
         CAST(o.o_orderdate AS DATE) AS date_input,
         o.o_orderstatus AS etat,
         o.o_orderpriority AS category_FR,
         CAST(c.c_nationkey AS BIGINT) AS quartier_id,
         CAST(n.n_regionkey AS BIGINT) AS code_postal_id,
         ((o.o_orderkey * 7919) % 100003 + 0.5) / 100003.0 * 5.4 - 0.2 AS lon,
         ((o.o_orderkey * 104729) % 100019 + 0.5) / 100019.0 * 5.4 - 0.2 AS lat
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

REPORT_LINES_SQL = """
report_lines AS (
  SELECT l.l_orderkey AS id_dmr,
         CAST(l.l_linenumber AS BIGINT) AS line,
         p.p_type || ' : ' || p.p_name AS soustype,
         l.l_shipdate AS date_etat_ts
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""

SHOPS_SQL = """
shops AS (
  SELECT s_suppkey AS id_,
         ((s_suppkey * 104729) % 100019 + 0.5) / 100019.0 * 5.4 - 0.2 AS lat,
         ((s_suppkey * 7919) % 100003 + 0.5) / 100003.0 * 5.4 - 0.2 AS lon,
         CASE WHEN s_acctbal >= 0 THEN 'shop' ELSE 'amenity' END AS category,
         CAST(s_nationkey AS BIGINT) AS subcategory,
         s_name AS name
  FROM supplier
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

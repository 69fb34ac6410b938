"""Cleaning jobs over the driver tables (T-06/T-07/T-08 and the SURVEY 3.1 plan).

Role (fixed): a raw report per line item; category = part type, the free-text
sub-category is the part name with a deterministic edit chosen by the line number, the
official list of a category is its distinct part names. Each edited text holds a name or is held by
one, so that SQL can say the answer: the first such name. The scorer itself is tested apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civlens.operators.fuzzy_correct import best_names, correct_subcategories
from civlens.plans.catalog import register
from civlens.plans.cleaning import clean_reports
from civlens.plans.scalar_queries import _mixed_date_text
from civlens.sources import tables

rt = tables.read_table


def edited_name(name: F.Column, n: F.Column) -> F.Column:
    return (
        F.when(n == 1, name)
        .when(n == 2, F.upper(name))
        .when(n == 3, F.expr("substring(p_name, 1, length(p_name) - 1)"))
        .when(n == 4, F.concat(F.lit("the "), name))
        .otherwise(F.concat(name, F.lit(" x")))
    )


def _lines(spark, d):
    li = rt(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    part = rt(spark, d, "part").select("p_partkey", "p_type", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey).withColumn(
        "txt", edited_name(F.col("p_name"), F.col("l_linenumber")))


def _official(spark, d):
    return rt(spark, d, "part").select(F.col("p_type").alias("category_FR"), F.col("p_name").alias("name_FR")).distinct()


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'))"
_T06_SQL = f"""
WITH l AS (SELECT p.p_type AS category_FR, CASE l.l_linenumber WHEN 1 THEN p.p_name WHEN 2 THEN upper(p.p_name)
             WHEN 3 THEN substr(p.p_name, 1, length(p.p_name) - 1) WHEN 4 THEN 'the ' || p.p_name
             ELSE p.p_name || ' x' END AS text_in
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
off AS (SELECT DISTINCT p_type AS category_FR, p_name AS name FROM part),
c AS (SELECT category_FR, text_in, COUNT(*) AS count FROM l GROUP BY 1, 2)
SELECT c.category_FR, c.text_in, MIN(off.name) AS subcategory_FR, ANY_VALUE(c.count) AS count
FROM c JOIN off ON c.category_FR = off.category_FR
WHERE contains({_PLAIN.format('c.text_in')}, {_PLAIN.format('off.name')})
   OR contains({_PLAIN.format('off.name')}, {_PLAIN.format('c.text_in')})
GROUP BY 1, 2"""


@register("t06_fuzzy_correction", _T06_SQL)
def t06_fuzzy_correction(spark, d):
    """T-06 / T-07 / T-08: free-text sub-categories corrected to official names, per
    distinct (category, text) with its row count."""
    lines = _lines(spark, d).select(F.col("p_type").alias("category_FR"), F.col("txt").alias("subcategory_FR"),
                                    F.col("txt").alias("text_in"))
    fixed = correct_subcategories(lines, _official(spark, d))
    return fixed.groupBy("category_FR", "text_in", "subcategory_FR").agg(F.count(F.lit(1)).alias("count"))


@register("c01_clean_reports")
def c01_clean_reports(spark, d):
    """SURVEY 3.1: the whole cleaning plan on raw report rows built from the driver
    tables; cleaned rows counted per (year, district, category, sub-category)."""
    lines = _lines(spark, d)
    o = _mixed_date_text(spark, d).withColumnRenamed("id_dmr", "l_orderkey")
    r = tables.reports(spark, d).select(F.col("id_dmr").alias("l_orderkey"), "lon", "lat", "code_postal_id", "etat")
    raw = lines.join(o, "l_orderkey").join(r, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("ID_DMR"),
        F.col("p_type").alias("TYPE"),
        F.concat_ws(" : ", "p_type", "txt").alias("SOUSTYPE"),
        F.col("datedecl").alias("DATEDECL"),
        F.col("lon").alias("X"), F.col("lat").alias("Y"),
        F.col("code_postal_id").cast("string").alias("ARRONDISSEMENT"),
        F.col("etat").alias("ETAT"),
        F.col("source").alias("_file_name"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("_seq"),
    )
    cleaned = clean_reports(raw, tables.districts(spark, d), _official(spark, d), bbox=(-0.2, -0.2, 5.2, 5.2),
                            cell=0.25)
    return cleaned.groupBy("year", "quartier_id", "category_FR", "subcategory_FR").agg(
        F.count(F.lit(1)).alias("count"))


@register("t07_fuzzy_best_name")
def t07_fuzzy_best_name(spark, d):
    """T-06 / T-07: names with two letters swapped or one replaced, and texts unlike any name, against
    the official names of their type: best name and score."""
    li = rt(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey")
    part = rt(spark, d, "part").select("p_partkey", F.col("p_type").alias("__cat"), F.col("p_name").alias("name"))
    at = F.col("l_orderkey") % F.greatest(F.length("name") - 1, F.lit(1)) + 1
    cut = lambda a, n=None: F.substring("name", a, F.lit(1000) if n is None else n)
    swapped = F.concat(cut(F.lit(1), (at - 1).cast("int")), cut((at + 1).cast("int"), F.lit(1)), cut(at.cast("int"), F.lit(1)), cut((at + 2).cast("int")))
    replaced = F.concat(cut(F.lit(1), (at - 1).cast("int")), F.lit("#"), cut((at + 1).cast("int")))
    kind = F.col("l_linenumber") % 3
    text = F.when(kind == 0, swapped).when(kind == 1, replaced).otherwise(F.concat(F.lit("qqq "), F.col("l_linenumber").cast("string"), F.lit(" zzz")))
    texts = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select("__cat", text.alias("__txt")).distinct()
    names = _official(spark, d).select(F.col("category_FR").alias("__cat"), F.col("name_FR").alias("__name"), F.col("name_FR").alias("__ord"))
    best = best_names(texts, names)
    return best.select(F.col("__cat").alias("category"), F.col("__txt").alias("text"), F.col("__name").alias("name"), F.col("__score").alias("score"))

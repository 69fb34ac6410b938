"""Scalar, filter, join, window and pivot jobs (D-*, T-*, P-*, J-*, W-05..W-10, U-01,
A-18..A-33) registered with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlens.functions import dates, text
from civlens.operators import aggregates as A
from civlens.operators import columns as P
from civlens.operators import joins as J
from civlens.operators import windows as W
from civlens.plans.catalog import register
from civlens.plans.report_queries import DETAILS_SQL, YEAR, _details, _reports
from civlens.sources import tables
from civlens.sources.tables import REPORT_LINES_SQL, REPORTS_SQL, with_ctes

R = REPORTS_SQL
rt = tables.read_table

# ---------------------------------------------------------------- dates

# Fixed role: each priority value stands for one source file with its own date layout;
# '4-NOT SPECIFIED' mixes two layouts, so no layout parses all of it (all-or-nothing -> null).
_MIXED_TEXT = """CASE o_orderpriority
    WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S')
    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
    WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                                     ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') END
    ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END"""


def _mixed_date_text(spark, d):
    o = rt(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    fmt = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED",
              F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
              .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    )
    return o.select(F.col("o_orderkey").alias("id_dmr"), F.col("o_orderpriority").alias("source"), fmt.alias("datedecl"))


@register("d01_convert_date_format", f"""
WITH t AS (SELECT o_orderkey AS id_dmr, o_orderpriority AS source, {_MIXED_TEXT} AS datedecl FROM orders),
ok AS (SELECT source,
              bool_and(datedecl IS NULL OR try_strptime(datedecl, '%Y-%m-%d %H:%M:%S') IS NOT NULL) AS ok0,
              bool_and(datedecl IS NULL OR try_strptime(datedecl, '%d/%m/%Y %H:%M:%S') IS NOT NULL) AS ok1,
              bool_and(datedecl IS NULL OR try_strptime(datedecl, '%d/%m/%Y %H:%M') IS NOT NULL) AS ok2
       FROM t GROUP BY source)
SELECT t.id_dmr, t.source,
       strftime(CASE WHEN ok0 THEN try_strptime(datedecl, '%Y-%m-%d %H:%M:%S')
                     WHEN ok1 THEN try_strptime(datedecl, '%d/%m/%Y %H:%M:%S')
                     WHEN ok2 THEN try_strptime(datedecl, '%d/%m/%Y %H:%M') END, '%Y-%m-%d %H:%M:%S') AS date_input
FROM t JOIN ok USING (source)""")
def d01_convert_date_format(spark, d):
    """D-01: per source, the first date layout that parses every value; else all null."""
    t = _mixed_date_text(spark, d)
    out = dates.convert_date_format(t, "datedecl", out="date_input", group_by=["source"])
    return out.select("id_dmr", "source", "date_input")


@register("d01_parse_per_value", f"""
WITH t AS (SELECT o_orderkey AS id_dmr, {_MIXED_TEXT} AS datedecl FROM orders)
SELECT id_dmr, strftime(coalesce(try_strptime(datedecl, '%Y-%m-%d %H:%M:%S'),
                                 try_strptime(datedecl, '%d/%m/%Y %H:%M:%S'),
                                 try_strptime(datedecl, '%d/%m/%Y %H:%M')), '%Y-%m-%d %H:%M:%S') AS date_input
FROM t""")
def d01_parse_per_value(spark, d):
    """D-01 per-value mode: each value parsed by the first layout that fits it."""
    t = _mixed_date_text(spark, d)
    return t.select("id_dmr", dates.parse_first_matching(F.col("datedecl")).alias("date_input"))


@register("d02_parse_hour_text", """
SELECT strftime(CAST(strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS DATE), '%Y-%m-%d') AS date,
       COUNT(*) AS count
FROM events GROUP BY 1""")
def d02_parse_hour_text(spark, d):
    """D-02: hourly text 'yyyy-MM-dd HH:mm' parsed with a fixed layout, counted per day."""
    e = rt(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t_1h"))
    parsed = e.select(F.to_date(F.to_timestamp("t_1h", "yyyy-MM-dd HH:mm")).alias("date"))
    return parsed.groupBy("date").agg(F.count(F.lit(1)).alias("count"))


@register("d03_elapsed_days", with_ctes(R, REPORT_LINES_SQL) + """
SELECT r.id_dmr, l.line,
       round((epoch(l.date_etat_ts) - epoch(CAST(r.date_input AS TIMESTAMP))) / 86400.0, 6) AS deltadays_signal_etat
FROM reports r JOIN report_lines l ON r.id_dmr = l.id_dmr""")
def d03_elapsed_days(spark, d):
    """D-03: days between the report and its status date (seconds / 86400)."""
    j = _reports(spark, d).join(tables.report_lines(spark, d), "id_dmr")
    return j.select("id_dmr", "line", dates.elapsed_days(F.col("date_input").cast("timestamp"),
                                                         F.col("date_etat_ts")).alias("deltadays_signal_etat"))


@register("d04_date_parts", """
SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day,
       COUNT(*) AS count
FROM events GROUP BY 1, 2, 3""")
def d04_date_parts(spark, d):
    """D-04: year, month and day parts of a timestamp, counted."""
    e = rt(spark, d, "events")
    return e.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("count"))


@register("d05_week_of_year", with_ctes(R) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(strftime(date_input, '%U') AS BIGINT) AS week,
       COUNT(*) AS count FROM reports GROUP BY 1, 2""")
def d05_week_of_year(spark, d):
    """D-05: reports per (year, Sunday-first week 0-53)."""
    r = _reports(spark, d)
    return r.groupBy(YEAR(), dates.week_sunday_first(F.col("date_input")).alias("week")).agg(
        F.count(F.lit(1)).alias("count"))


@register("d06_weekend_counts", with_ctes(R) + """
SELECT CAST(isodow(date_input) > 5 AS BIGINT) AS weekend, COUNT(*) AS count FROM reports GROUP BY 1""")
def d06_weekend_counts(spark, d):
    """D-06: reports on weekdays (0) and weekends (1)."""
    r = _reports(spark, d)
    return r.groupBy(dates.is_weekend(F.col("date_input")).alias("weekend")).agg(F.count(F.lit(1)).alias("count"))


@register("d07_dayofweek_counts", with_ctes(R) + """
SELECT CAST(isodow(date_input) - 1 AS BIGINT) AS dayofweek, COUNT(*) AS count FROM reports GROUP BY 1""")
def d07_dayofweek_counts(spark, d):
    """D-07: reports per day of week, Monday = 0."""
    r = _reports(spark, d)
    return r.groupBy(dates.day_of_week_monday0(F.col("date_input")).alias("dayofweek")).agg(
        F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- text

@register("t01_parse_soustype", with_ctes(REPORT_LINES_SQL) + """
SELECT soustype, trim(split_part(replace(soustype, '[]', ''), ':', 1)) AS main,
       CASE WHEN strpos(replace(soustype, '[]', ''), ':') > 0
            THEN trim(split_part(replace(soustype, '[]', ''), ':', 2)) END AS extra,
       COUNT(*) AS count
FROM report_lines GROUP BY soustype""")
def t01_parse_soustype(spark, d):
    """T-01 / T-03: "main : extra" split with Unicode trim, per distinct text with its count."""
    lines = tables.report_lines(spark, d)
    g = lines.groupBy("soustype").agg(F.count(F.lit(1)).alias("count"))
    p = g.withColumn("__p", text.parse_soustype(F.col("soustype")))
    return p.select("soustype", F.col("__p.main").alias("main"), F.col("__p.extra").alias("extra"), "count")


# Fixed role values: translation table for the driver's category codes; '5-LOW' is left
# out on purpose so that unknown values map to null.
PRIORITY_EN = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "not_specified"}


@register("t02_translate_category", with_ctes(R) + """
SELECT category_FR,
       CASE trim(category_FR) WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'not_specified' END AS category_EN,
       COUNT(*) AS count
FROM reports GROUP BY category_FR""")
def t02_translate_category(spark, d):
    """T-02: literal-map translation after trim; unknown -> null."""
    r = _reports(spark, d).groupBy("category_FR").agg(F.count(F.lit(1)).alias("count"))
    return r.select("category_FR", text.translate_category(F.col("category_FR"), PRIORITY_EN).alias("category_EN"),
                    "count")


@register("t04_postcode_long", """
SELECT c_custkey,
       left('75000', greatest(5 - length(CAST(c_custkey AS VARCHAR)), 0)) || CAST(c_custkey AS VARCHAR) AS code_postal_long
FROM customer""")
def t04_postcode_long(spark, d):
    """T-04: code written over the tail of "75000" (5 -> 75005); long codes unchanged."""
    c = rt(spark, d, "customer")
    return c.select("c_custkey", text.postcode_long(F.col("c_custkey")).alias("code_postal_long"))


@register("t05_suffix_ids", """
SELECT c_custkey,
       CASE WHEN CAST(c_nationkey AS VARCHAR) IN ('1', '2', '3', '4') THEN CAST(c_nationkey AS VARCHAR) || '_OLD'
            ELSE CAST(c_nationkey AS VARCHAR) END AS code_postal_id
FROM customer""")
def t05_suffix_ids(spark, d):
    """T-05: merged district ids 1..4 renamed to '1_OLD'.. ."""
    c = rt(spark, d, "customer")
    return c.select("c_custkey", text.suffix_ids(F.col("c_nationkey"), ["1", "2", "3", "4"]).alias("code_postal_id"))


@register("t09_first_of_list", """
SELECT split_part(p_type || ';' || p_brand, ';', 1) AS subcategory, COUNT(*) AS count FROM part GROUP BY 1""")
def t09_first_of_list(spark, d):
    """T-09: first element of a ';' list (OSM tag value)."""
    p = rt(spark, d, "part").select(F.concat_ws(";", "p_type", "p_brand").alias("tag"))
    return p.groupBy(text.first_of_list(F.col("tag")).alias("subcategory")).agg(F.count(F.lit(1)).alias("count"))


@register("t10_apostrophes", """
SELECT doc_id, length(text) - length(replace(text, '’', ''))
       AS n_fixed,
       md5(translate(text, '’', '''')) AS text_md5
FROM documents""")
def t10_apostrophes(spark, d):
    """T-10: typographic apostrophes normalised over whole texts (count changed, digest of result)."""
    doc = rt(spark, d, "documents")
    fixed = text.normalise_apostrophes(F.col("text"))
    n_fixed = F.length("text") - F.length(F.replace("text", F.lit("’"), F.lit("")))
    return doc.select("doc_id", n_fixed.cast("bigint").alias("n_fixed"), F.md5(fixed).alias("text_md5"))


@register("t12_is_ascii", """
SELECT lang, CAST(strlen(text) = length(text) AS BIGINT) AS is_ascii, COUNT(*) AS count
FROM documents GROUP BY 1, 2""")
def t12_is_ascii(spark, d):
    """T-12: ASCII-only texts per language."""
    doc = rt(spark, d, "documents")
    return doc.groupBy("lang", text.is_ascii(F.col("text")).cast("bigint").alias("is_ascii")).agg(
        F.count(F.lit(1)).alias("count"))


@register("t13_json_field", """
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COUNT(*) AS count FROM events GROUP BY 1""")
def t13_json_field(spark, d):
    """T-13: a field read out of JSON text, counted per value."""
    e = rt(spark, d, "events")
    return e.groupBy(text.json_field(F.col("props"), "$.k").cast("bigint").alias("k")).agg(
        F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- projections and filters

@register("p01_p04_standardise_columns", with_ctes(R) + """
SELECT id_dmr, lon AS x, lat AS y, category_FR AS type FROM reports""")
def p01_p04_standardise_columns(spark, d):
    """P-01..P-04: lower-case names, rename, drop, reorder (inverse renames of the role)."""
    r = _reports(spark, d)
    up = r.toDF(*[c.upper() for c in r.columns])
    low = P.lower_columns(up)
    ren = P.rename(low, {"lon": "x", "lat": "y", "category_fr": "type"})
    return P.drop_if_present(ren, "oid_", "etat", "date_input", "quartier_id", "code_postal_id").select(
        F.col("id_dmr"), "x", "y", "type")


@register("p05_u01_union_padded", with_ctes(R) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, etat, COUNT(*) AS count FROM (
  SELECT date_input, etat FROM reports WHERE year(date_input) >= 2000
  UNION ALL
  SELECT date_input, NULL AS etat FROM reports WHERE year(date_input) < 2000) u
GROUP BY 1, 2""")
def p05_u01_union_padded(spark, d):
    """P-05 / U-01 / U-02: yearly slices with and without a status column, unioned by
    name with null padding, counted per (year, status)."""
    r = _reports(spark, d)
    recent = r.where(F.year("date_input") >= 2000).select("date_input", "etat")
    old = r.where(F.year("date_input") < 2000).select("date_input")
    schema = T.StructType([T.StructField("date_input", T.DateType()), T.StructField("etat", T.StringType())])
    u = W.union_all([recent, P.pad_columns(old, schema)])
    return u.groupBy(YEAR(), "etat").agg(F.count(F.lit(1)).alias("count"))


@register("p06_bbox_filter", with_ctes(R) + """
SELECT quartier_id, COUNT(*) AS count FROM reports
WHERE lon BETWEEN 0.5 AND 4.5 AND lat BETWEEN 0.5 AND 4.5 GROUP BY 1""")
def p06_bbox_filter(spark, d):
    """P-06: inclusive bounding-box filter (null coordinates kept), counted per district."""
    r = P.bbox_filter(_reports(spark, d), (0.5, 0.5, 4.5, 4.5))
    return A.count_by(r, ["quartier_id"])


@register("p07_not_equal_keep_null", """
SELECT o_orderstatus AS etat, COUNT(*) AS count FROM (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders) t
WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY 1""")
def p07_not_equal_keep_null(spark, d):
    """P-07: status != 'F' keeping null statuses (low priority plays the unknown status)."""
    o = rt(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("etat"))
    return A.count_by(P.not_equal_keep_null(o, "etat", "F"), ["etat"])


_DOC_LABELS_SQL = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _doc_labels(spark, d):
    doc = rt(spark, d, "documents").select("doc_id")
    lab = rt(spark, d, "labels")
    return doc.join(lab, "doc_id", "left")


@register("p08_p09_dropna", f"""
SELECT doc_id, quality, toxic FROM ({_DOC_LABELS_SQL}) t WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def p08_p09_dropna(spark, d):
    """P-08 / P-09 / P-10: rows with a null in any column dropped."""
    return P.drop_null_rows(_doc_labels(spark, d))


@register("p11_fillna_zero", f"""
SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM ({_DOC_LABELS_SQL}) t""")
def p11_fillna_zero(spark, d):
    """P-11: nulls filled with 0."""
    return P.fill_zero(_doc_labels(spark, d), ["quality", "toxic"])


@register("p13_p14_derived_columns", """
SELECT c_nationkey AS quartier_id, round(SUM(c_acctbal) / COUNT(*), 6) AS acctbal_per_customer,
       round(SUM(c_acctbal) / 1000.0, 6) AS acctbal_k, CAST(COUNT(*) AS VARCHAR) AS n_text
FROM customer GROUP BY 1""")
def p13_p14_derived_columns(spark, d):
    """P-13 / P-14: ratio, unit change and casts on an aggregate."""
    c = rt(spark, d, "customer").groupBy(F.col("c_nationkey").alias("quartier_id")).agg(
        F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    return c.select("quartier_id", F.try_divide(F.col("s"), F.col("n")).alias("acctbal_per_customer"),
                    (F.col("s") / 1000.0).alias("acctbal_k"), F.col("n").cast("string").alias("n_text"))


@register("p15_split_lat_lon", with_ctes(R) + """
SELECT id_dmr, CAST(CAST(lat AS VARCHAR) AS DOUBLE) AS lat, CAST(CAST(lon AS VARCHAR) AS DOUBLE) AS lon FROM reports""")
def p15_split_lat_lon(spark, d):
    """P-15: "lat,lon" text split into two doubles."""
    r = _reports(spark, d).select("id_dmr", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
                                  .alias("geo_point_2d"))
    s = r.withColumn("__p", P.split_lat_lon(F.col("geo_point_2d")))
    return s.select("id_dmr", F.col("__p.lat").alias("lat"), F.col("__p.lon").alias("lon"))


@register("p17_relabel_rare", """
SELECT label, CASE WHEN label = 2 OR (label > 3 AND label <> 8) THEN 9 ELSE label END AS new_label, COUNT(*) AS count
FROM embeddings GROUP BY 1""")
def p17_relabel_rare(spark, d):
    """P-17: rare classes relabelled 9, keeping 0, 1, 3, 8."""
    e = rt(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("count")).select(
        "label", P.relabel_rare(F.col("label")).alias("new_label"), "count")


# ---------------------------------------------------------------- joins

@register("j01_subcategory_join_main", """
WITH main AS (SELECT DISTINCT p_type AS category_id, lower(p_type) AS name_FR FROM part)
SELECT p.p_partkey, p.p_name AS name_FR_sub, m.name_FR AS name_FR_main
FROM part p LEFT JOIN main m ON p.p_type = m.category_id""")
def j01_subcategory_join_main(spark, d):
    """J-01: sub-categories left join their main category (overlapping names suffixed)."""
    part = rt(spark, d, "part")
    main = part.select(F.col("p_type").alias("category_id")).distinct().withColumn("name_FR", F.lower("category_id"))
    sub = part.select("p_partkey", F.col("p_type").alias("category_id"), F.col("p_name").alias("name_FR"))
    j = J.left_join_dim(sub.withColumnRenamed("name_FR", "name_FR_sub"), main, "category_id")
    return j.select("p_partkey", "name_FR_sub", F.col("name_FR").alias("name_FR_main"))


@register("j02_j03_district_dims", """
WITH pop AS (SELECT c_nationkey, COUNT(*) AS pop_2021 FROM customer GROUP BY 1)
SELECT CAST(n.n_nationkey AS BIGINT) AS quartier_id, CAST(n.n_regionkey AS BIGINT) AS code_postal_id,
       n.n_name AS name, r.r_name AS postcode_name, p.pop_2021
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN pop p ON n.n_nationkey = p.c_nationkey""")
def j02_j03_district_dims(spark, d):
    """J-02 / J-03: districts left join postcode dimension and population."""
    n = rt(spark, d, "nation").select(F.col("n_nationkey").alias("quartier_id"), F.col("n_regionkey").alias("code_postal_id"),
                                      F.col("n_name").alias("name"))
    reg = rt(spark, d, "region").select(F.col("r_regionkey").alias("code_postal_id"), F.col("r_name").alias("postcode_name"))
    pop = rt(spark, d, "customer").groupBy(F.col("c_nationkey").alias("quartier_id")).agg(
        F.count(F.lit(1)).alias("pop_2021"))
    return J.chain_left_joins(J.left_join_dim(n, reg, "code_postal_id"), [pop], "quartier_id")


@register("j06_composite_key_join", with_ctes(R, REPORT_LINES_SQL, """
a AS (SELECT date_input AS date, quartier_id, COUNT(*) AS n_reports FROM reports GROUP BY 1, 2),
b AS (SELECT CAST(l.date_etat_ts AS DATE) AS date, r.quartier_id, COUNT(*) AS n_closed
      FROM report_lines l JOIN reports r ON l.id_dmr = r.id_dmr GROUP BY 1, 2)""") + """
SELECT strftime(a.date, '%Y-%m-%d') AS date, a.quartier_id, a.n_reports, b.n_closed
FROM a LEFT JOIN b ON a.date = b.date AND a.quartier_id = b.quartier_id""")
def j06_composite_key_join(spark, d):
    """J-06: daily counts per district left join a second daily series on (date, district)."""
    r = _reports(spark, d)
    a = r.groupBy(F.col("date_input").alias("date"), "quartier_id").agg(F.count(F.lit(1)).alias("n_reports"))
    lines = tables.report_lines(spark, d).join(r.select("id_dmr", "quartier_id"), "id_dmr")
    b = lines.groupBy(F.to_date("date_etat_ts").alias("date"), "quartier_id").agg(F.count(F.lit(1)).alias("n_closed"))
    return a.join(b, ["date", "quartier_id"], "left")


@register("j08_fanout_left_join", """
SELECT o.o_orderstatus, COUNT(*) AS n_rows, COUNT(l.l_orderkey) AS n_matched
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1""")
def j08_fanout_left_join(spark, d):
    """J-08: left join onto a key with several rows per value (fan-out), counted."""
    o = rt(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    li = rt(spark, d, "lineitem").select("l_orderkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return j.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.count("l_orderkey").alias("n_matched"))


# ---------------------------------------------------------------- windows and dedup

_DAILY_SQL = with_ctes(R, """
dd AS (SELECT date_input AS date, quartier_id, COUNT(*) AS count FROM reports GROUP BY 1, 2)""")


def _daily_by_district(spark, d):
    return _reports(spark, d).groupBy(F.col("date_input").alias("date"), "quartier_id").agg(
        F.count(F.lit(1)).alias("count"))


@register("w05_lead_features", _DAILY_SQL + """
SELECT * FROM (
  SELECT strftime(date, '%Y-%m-%d') AS date, quartier_id, count,
         LEAD(count, 1) OVER w AS f_1, LEAD(count, 2) OVER w AS f_2, LEAD(count, 3) OVER w AS f_0
  FROM dd WINDOW w AS (PARTITION BY quartier_id ORDER BY date)) t
WHERE f_1 IS NOT NULL AND f_2 IS NOT NULL AND f_0 IS NOT NULL""")
def w05_lead_features(spark, d):
    """W-05: lead features (window 3) per district series of daily counts."""
    return W.lead_features(_daily_by_district(spark, d), "count", 3, ["date"], ["quartier_id"])


@register("w05_lead_features_global", _DAILY_SQL + """
SELECT * FROM (
  SELECT strftime(date, '%Y-%m-%d') AS date, quartier_id, count,
         LEAD(count, 1) OVER w AS f_1, LEAD(count, 2) OVER w AS f_2, LEAD(count, 3) OVER w AS f_0
  FROM dd WINDOW w AS (ORDER BY date, quartier_id)) t
WHERE f_1 IS NOT NULL AND f_2 IS NOT NULL AND f_0 IS NOT NULL""")
def w05_lead_features_global(spark, d):
    """W-05 parity mode (Q-12): one lead series over rows ordered by (date, district)."""
    return W.lead_features(_daily_by_district(spark, d), "count", 3, ["date", "quartier_id"])


@register("w06_dedup_keep_last", """
WITH s AS (SELECT *, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem)
SELECT l_orderkey, arg_max(l_linenumber, seq) AS l_linenumber,
       arg_max(l_partkey, seq) AS l_partkey, round(arg_max(l_quantity, seq), 6) AS l_quantity
FROM s GROUP BY l_orderkey""")
def w06_dedup_keep_last(spark, d):
    """W-06: one row per key, the last one by an explicit (total) sequence."""
    li = rt(spark, d, "lineitem")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                   F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"))
    return W.dedup_keep_last(li, "l_orderkey", "seq").drop("seq")


@register("w07_mark_duplicates", """
WITH k AS (SELECT l_partkey, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l.l_returnflag, CAST(k.n > 1 AS BIGINT) AS is_dup, COUNT(*) AS count
FROM lineitem l JOIN k ON l.l_partkey = k.l_partkey AND l.l_returnflag = k.l_returnflag GROUP BY 1, 2""")
def w07_mark_duplicates(spark, d):
    """W-07: every row whose (part, flag) key occurs more than once is marked (keep=False)."""
    li = rt(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    m = W.mark_duplicates(li, ["l_partkey", "l_returnflag"])
    return m.groupBy("l_returnflag", "is_dup").agg(F.count(F.lit(1)).alias("count"))


# Fixed role: a line "version" is available from its ship date for 30 days per line number.
_VERSIONS_SQL = """
v AS (SELECT l_orderkey AS arc, l_linenumber AS version, CAST(l_shipdate AS DATE) AS start,
             CAST(l_shipdate AS DATE) + CAST(30 * l_linenumber AS INTEGER) AS fin FROM lineitem)"""


@register("w08_choose_version", with_ctes(_VERSIONS_SQL, """
s AS (SELECT arc, COUNT(*) AS n, MAX(CAST(fin < DATE '1999-01-01' AS INTEGER)) AS any_ended,
             MIN({'a': start, 'b': version, 'c': fin}) AS first_row
      FROM v GROUP BY arc)""") + """
SELECT v.arc, CAST(v.version AS BIGINT) AS version FROM v JOIN s USING (arc)
WHERE s.n = 1 OR (CASE WHEN s.any_ended = 1 THEN NOT (v.fin < DATE '1999-01-01') ELSE {'a': v.start, 'b': v.version, 'c': v.fin} = s.first_row END)""")
def w08_choose_version(spark, d):
    """W-08: per duplicated arc drop versions ended before the cutoff, else keep the earliest."""
    li = rt(spark, d, "lineitem")
    v = li.select(F.col("l_orderkey").alias("arc"), F.col("l_linenumber").alias("version"),
                  F.to_date("l_shipdate").alias("start"))
    v = v.withColumn("fin", F.date_add("start", (F.col("version") * 30).cast("int")))
    return W.choose_version(v, "arc", "start", "fin", "1999-01-01").select("arc", "version")


@register("w10_top1_per_group", """
SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey,
       round(max(o_totalprice), 6) AS o_totalprice
FROM orders GROUP BY o_custkey""")
def w10_top1_per_group(spark, d):
    """W-09 / W-10: first row per group after a descending sort (ties by key)."""
    o = rt(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    o = o.withColumn("__rank", F.struct("o_totalprice", "o_orderkey"))
    return W.top1_by(o, ["o_custkey"], "__rank", ["o_orderkey", "o_totalprice"])


# ---------------------------------------------------------------- grouped and pivoted

@register("a18_pivot_margin", with_ctes(DETAILS_SQL) + """
SELECT quartier_id, COUNT(id_dmr) AS "All" FROM details
WHERE quartier_id IS NOT NULL AND subcategory_FR IS NOT NULL AND id_dmr IS NOT NULL GROUP BY 1""")
def a18_pivot_margin(spark, d):
    """A-18: pivot district x sub-category with margins, the 'All' margin kept (complete rows)."""
    det = _details(spark, d).select("quartier_id", "subcategory_FR", "id_dmr")
    return A.margin_count(det, "quartier_id", "id_dmr", complete_rows=True)


@register("a19_two_stage_sum", with_ctes(R) + """
SELECT quartier_id, round(SUM(q), 6) AS l_quantity FROM (
  SELECT l.l_returnflag, r.quartier_id, SUM(l.l_quantity) AS q
  FROM lineitem l JOIN reports r ON l.l_orderkey = r.id_dmr GROUP BY 1, 2) t GROUP BY 1""")
def a19_two_stage_sum(spark, d):
    """A-19: sum by (regime, district), then by district."""
    li = rt(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    j = li.join(_reports(spark, d).select(F.col("id_dmr").alias("l_orderkey"), "quartier_id"), "l_orderkey")
    return A.two_stage_sum(j, ["l_returnflag", "quartier_id"], ["quartier_id"], ["l_quantity"])


@register("a20_a21_sum_mean_by_district", """
SELECT CAST(s_nationkey AS BIGINT) AS quartier_id, round(SUM(s_acctbal), 6) AS s_acctbal,
       round(AVG(s_acctbal), 6) AS mean_acctbal
FROM supplier GROUP BY 1""")
def a20_a21_sum_mean_by_district(spark, d):
    """A-20 / A-21: sum and mean per district."""
    s = rt(spark, d, "supplier").withColumnRenamed("s_nationkey", "quartier_id")
    return s.groupBy("quartier_id").agg(F.sum("s_acctbal").alias("s_acctbal"), F.avg("s_acctbal").alias("mean_acctbal"))


# Fixed role: the five event types in sorted order stand for traffic states 0..4.
EVENT_STATES = ["click", "error", "purchase", "signup", "view"]


@register("a23_pivot_states", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, user_id,
       COUNT(*) FILTER (WHERE event_type = 'click') AS etat_trafic_0,
       COUNT(*) FILTER (WHERE event_type = 'error') AS etat_trafic_1,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS etat_trafic_2,
       COUNT(*) FILTER (WHERE event_type = 'signup') AS etat_trafic_3,
       COUNT(*) FILTER (WHERE event_type = 'view') AS etat_trafic_4,
       COUNT(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN
                        ('click', 'error', 'purchase', 'signup', 'view')) AS etat_other
FROM events GROUP BY 1, 2""")
def a23_pivot_states(spark, d):
    """A-23: pivot counts of states by (date, arc), zeros filled, renamed etat_trafic_i."""
    e = rt(spark, d, "events").select(F.to_date("ts").alias("date"), "user_id", "event_type")
    known = F.coalesce(F.col("event_type").isin(EVENT_STATES), F.lit(False))
    e = e.withColumn("event_type", F.when(known, F.col("event_type")).otherwise("other"))
    p = A.pivot_count(e, ["date", "user_id"], "event_type", [*EVENT_STATES, "other"])
    names = {s: f"etat_trafic_{i}" for i, s in enumerate(EVENT_STATES)}
    return p.withColumnsRenamed(names | {"other": "etat_other"})


@register("a24_sum_by_date_district", """
SELECT strftime(CAST(e.ts AS DATE), '%Y-%m-%d') AS date, CAST(c.c_nationkey AS BIGINT) AS quartier_id,
       round(SUM(e.value), 6) AS value, COUNT(*) AS n_events
FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1, 2""")
def a24_sum_by_date_district(spark, d):
    """A-24: sums by (date, district) of a measure joined through the user's district."""
    e = rt(spark, d, "events").select(F.to_date("ts").alias("date"), "user_id", "value")
    c = rt(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("quartier_id"))
    j = e.join(c, "user_id")
    return j.groupBy("date", "quartier_id").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_events"))


@register("a26_value_counts_pct", with_ctes(R) + """
SELECT etat, category_FR, COUNT(*) AS count,
       round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY etat) * 100.0, 6) AS pct
FROM reports WHERE category_FR IS NOT NULL GROUP BY 1, 2""")
def a26_value_counts_pct(spark, d):
    """A-26 / M-25: value counts of category per status, with the share in percent."""
    return A.value_counts(_reports(spark, d), "category_FR", by=["etat"], pct=True)


@register("a28_duplicate_count", """
SELECT COUNT(*) - COUNT(DISTINCT l_orderkey) - MAX(CAST(l_orderkey IS NULL AS BIGINT)) AS n_duplicates FROM lineitem""")
def a28_duplicate_count(spark, d):
    """A-28: duplicate rows per key (rows minus distinct keys)."""
    return A.duplicate_count(rt(spark, d, "lineitem"), "l_orderkey")


@register("a32_distinct_values", with_ctes(R) + "SELECT DISTINCT etat, category_FR FROM reports")
def a32_distinct_values(spark, d):
    """A-32: distinct value combinations."""
    return A.distinct_values(_reports(spark, d), ["etat", "category_FR"])


YEARS = list(range(1995, 2002))


@register("a33_pivot_years_total", with_ctes(DETAILS_SQL, """
p AS (SELECT category_FR, subcategory_FR,
""" + ",\n".join(f"COUNT(*) FILTER (WHERE year(date_input) = {y}) AS \"{y}\"" for y in YEARS) + """,
             COUNT(*) FILTER (WHERE NOT coalesce(year(date_input) BETWEEN 1995 AND 2001, false)) AS other_years,
             COUNT(*) AS "Total"
      FROM details GROUP BY 1, 2)""") + """
SELECT *, round("Total" / SUM("Total") OVER (PARTITION BY category_FR) * 100.0, 6) AS share_in_category FROM p""")
def a33_pivot_years_total(spark, d):
    """A-33: (category, sub-category) x year counts with a Total and the share within category."""
    det = _details(spark, d).withColumn("year", F.year("date_input"))
    return A.pivot_years_with_total(det, ["category_FR", "subcategory_FR"], "year", YEARS)

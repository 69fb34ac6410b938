"""Report aggregates for dashboards and the SQL insight queries (A-01..A-17, A-22, A-25,
W-01..W-04, U-03), registered with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlens.functions import dates, geo, text
from civlens.operators import aggregates as A
from civlens.operators import windows as W
from civlens.plans.catalog import register
from civlens.sources import tables
from civlens.sources.tables import REPORT_LINES_SQL, REPORTS_SQL, with_ctes

# Years from this one on play the role of the "recent years with a status" (2021+).
RECENT_FROM_YEAR = 2000

R = REPORTS_SQL
def YEAR():
    return F.year("date_input").cast("bigint").alias("year")

def MONTH():
    return F.month("date_input").cast("bigint").alias("month")



def _reports(spark: SparkSession, d: str) -> DataFrame:
    return tables.reports(spark, d)


def _details(spark: SparkSession, d: str) -> DataFrame:
    """Reports with one detail row per sub-category line (main / extra parsed, T-01)."""
    lines = tables.report_lines(spark, d)
    parsed = lines.withColumn("__st", text.parse_soustype(F.col("soustype"))).select(
        "id_dmr", F.col("__st.main").alias("subcategory_FR"), F.col("__st.extra").alias("extrainfo")
    )
    return _reports(spark, d).join(parsed, on="id_dmr", how="inner")


DETAILS_SQL = R + "," + REPORT_LINES_SQL + """,
details AS (
  SELECT r.*, trim(split_part(l.soustype, ':', 1)) AS subcategory_FR,
         CASE WHEN strpos(l.soustype, ':') > 0 THEN trim(split_part(l.soustype, ':', 2)) END AS extrainfo
  FROM reports r JOIN report_lines l ON r.id_dmr = l.id_dmr
)"""


def postcode_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area per postcode = sum of its districts' polygon areas (computed from geometry)."""
    dist = tables.districts(spark, d).withColumn("surface_km2", geo.area(F.col("geometry")))
    return dist.groupBy("code_postal_id").agg(F.sum("surface_km2").alias("surface_km2"))


AREAS_SQL = """
areas AS (SELECT CAST(n_regionkey AS BIGINT) AS code_postal_id, SUM(CAST(0.75 AS DOUBLE)) AS surface_km2
          FROM nation GROUP BY 1)"""


# ---------------------------------------------------------------- SQL insight queries


@register("w01_yearly_change", with_ctes(R, """
yc AS (SELECT CAST(year(date_input) AS BIGINT) AS year, COUNT(*) AS count FROM reports GROUP BY 1)""") + """
SELECT year, count, LAG(count) OVER (ORDER BY year) AS count_previous_year,
       round((count - LAG(count) OVER (ORDER BY year)) / LAG(count) OVER (ORDER BY year) * 100.0, 6) AS perc_diff
FROM yc""")
def w01_yearly_change(spark, d):
    """W-01: reports per year, previous year's count and % change."""
    yc = _reports(spark, d).groupBy(YEAR()).agg(F.count(F.lit(1)).alias("count"))
    return W.lag_change(yc, ["year"], "count", "count_previous_year", "perc_diff")


@register("w02_year_month_change", with_ctes(R, """
ym AS (SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
              COUNT(*) AS count FROM reports GROUP BY 1, 2)""") + """
SELECT year, month, count, LAG(count) OVER (ORDER BY year, month) AS count_previous_month FROM ym""")
def w02_year_month_change(spark, d):
    """W-02: reports per (year, month) and the previous month's count."""
    ym = _reports(spark, d).groupBy(YEAR(), MONTH()).agg(F.count(F.lit(1)).alias("count"))
    return W.lag_change(ym, ["year", "month"], "count", "count_previous_month", None)


@register("w03_month_change", with_ctes(R, """
m AS (SELECT CAST(month(date_input) AS BIGINT) AS month, COUNT(*) AS count FROM reports GROUP BY 1)""") + """
SELECT month, count, LAG(count) OVER (ORDER BY month) AS count_previous_month FROM m""")
def w03_month_change(spark, d):
    """W-03: reports per calendar month and the previous month's count."""
    m = _reports(spark, d).groupBy(MONTH()).agg(F.count(F.lit(1)).alias("count"))
    return W.lag_change(m, ["month"], "count", "count_previous_month", None)


@register("a11_total_count", with_ctes(R) + "SELECT COUNT(*) AS count FROM reports")
def a11_total_count(spark, d):
    """A-11: total number of reports."""
    return _reports(spark, d).agg(F.count(F.lit(1)).alias("count"))


@register("a12_avg_weekly_count", with_ctes(R, """
w AS (SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(strftime(date_input, '%U') AS BIGINT) AS week,
             COUNT(*) AS count FROM reports GROUP BY 1, 2)""") + """
SELECT year, round(AVG(count), 6) AS avg_count FROM w GROUP BY year""")
def a12_avg_weekly_count(spark, d):
    """A-12: average of weekly counts per year (Sunday-first weeks, 0-53)."""
    r = _reports(spark, d)
    return A.avg_of_group_counts(r, [YEAR()], [dates.week_sunday_first(F.col("date_input")).alias("week")])


@register("a13_count_by_postcode", with_ctes(R) + """
SELECT code_postal_id, COUNT(*) AS count FROM reports GROUP BY code_postal_id""")
def a13_count_by_postcode(spark, d):
    """A-13: reports per postcode."""
    return W.ordered(A.count_by(_reports(spark, d), ["code_postal_id"]), "count", desc=True)


@register("a13_count_by_category", with_ctes(R) + """
SELECT category_FR, COUNT(*) AS count FROM reports GROUP BY category_FR""")
def a13_count_by_category(spark, d):
    """A-13: reports per category."""
    return W.ordered(A.count_by(_reports(spark, d), ["category_FR"]), "count", desc=True)


@register("a13_count_by_category_year", with_ctes(R) + """
SELECT category_FR, CAST(year(date_input) AS BIGINT) AS year, COUNT(*) AS count
FROM reports GROUP BY 1, 2""")
def a13_count_by_category_year(spark, d):
    """A-13: reports per (category, year)."""
    return W.ordered(A.count_by(_reports(spark, d), ["category_FR", YEAR()]), "count", desc=True)


@register("a13_count_by_etat", with_ctes(R) + """
SELECT etat, COUNT(id_dmr) AS count_events FROM reports GROUP BY etat""")
def a13_count_by_etat(spark, d):
    """A-13: reports per status, counting non-null ids."""
    return W.ordered(A.count_by(_reports(spark, d), ["etat"], "count_events", count_col="id_dmr"), "count_events", True)


@register("a14_distinct_etat", with_ctes(R) + "SELECT COUNT(DISTINCT etat) AS n_etat FROM reports")
def a14_distinct_etat(spark, d):
    """A-14: number of distinct statuses (null ignored)."""
    return _reports(spark, d).agg(F.count_distinct("etat").alias("n_etat"))


@register("a16_count_by_postcode_quartier", with_ctes(R) + """
SELECT code_postal_id, quartier_id, COUNT(*) AS count FROM reports GROUP BY 1, 2""")
def a16_count_by_postcode_quartier(spark, d):
    """A-16: reports per (postcode, district)."""
    return A.count_by(_reports(spark, d), ["code_postal_id", "quartier_id"])


@register("a17_share_by_etat", with_ctes(R, """
c AS (SELECT etat, COUNT(*) AS count FROM reports GROUP BY etat)""") + """
SELECT etat, count, round(count / (SELECT SUM(count) FROM c) * 100.0, 6) AS share_pct FROM c""")
def a17_share_by_etat(spark, d):
    """A-17 / J-12: share of the total per status, in percent."""
    c = A.count_by(_reports(spark, d), ["etat"])
    return A.share_of_total(c, "count", "share_pct")


@register("u03_primary_key_check", with_ctes(R) + """
SELECT id_dmr, COUNT(*) AS count FROM reports GROUP BY id_dmr HAVING COUNT(*) > 1""")
def u03_primary_key_check(spark, d):
    """U-03: report ids occurring more than once (empty = primary key holds)."""
    return W.primary_key_violations(_reports(spark, d), "id_dmr")


# ---------------------------------------------------------------- dashboard exports


@register("a01_daily_count", with_ctes(R) + """
SELECT strftime(date_input, '%Y-%m-%d') AS date, COUNT(*) AS count FROM reports GROUP BY 1""")
def a01_daily_count(spark, d):
    """A-01: reports per day."""
    return A.daily_count(_reports(spark, d))


@register("a02_count_ym_district_category", with_ctes(R) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
       code_postal_id, quartier_id, category_FR, COUNT(id_dmr) AS count
FROM reports
WHERE code_postal_id IS NOT NULL AND quartier_id IS NOT NULL AND category_FR IS NOT NULL
GROUP BY ALL""")
def a02_count_ym_district_category(spark, d):
    """A-02: counts per (year, month, postcode, district, category), frame counting rules."""
    return A.count_by(_reports(spark, d), [YEAR(), MONTH(), "code_postal_id", "quartier_id", "category_FR"],
                      count_col="id_dmr", drop_null_keys=True)


def _density(spark, d, keys):
    c = A.count_by(_reports(spark, d), keys, count_col="id_dmr", drop_null_keys=True)
    return A.count_per_area(c, postcode_areas(spark, d), "code_postal_id", "surface_km2")


@register("a03_density_ym_postcode_category", with_ctes(R, AREAS_SQL) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
       r.code_postal_id, category_FR, COUNT(id_dmr) AS count,
       round(COUNT(id_dmr) / ANY_VALUE(a.surface_km2), 6) AS count_per_km2
FROM reports r LEFT JOIN areas a ON r.code_postal_id = a.code_postal_id
WHERE r.code_postal_id IS NOT NULL AND category_FR IS NOT NULL
GROUP BY 1, 2, 3, 4""")
def a03_density_ym_postcode_category(spark, d):
    """A-03: counts and counts per km2 by (year, month, postcode, category)."""
    return _density(spark, d, [YEAR(), MONTH(), "code_postal_id", "category_FR"])


@register("a04_density_year_postcode", with_ctes(R, AREAS_SQL) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, r.code_postal_id, COUNT(id_dmr) AS count,
       round(COUNT(id_dmr) / ANY_VALUE(a.surface_km2), 6) AS count_per_km2
FROM reports r LEFT JOIN areas a ON r.code_postal_id = a.code_postal_id
WHERE r.code_postal_id IS NOT NULL
GROUP BY 1, 2""")
def a04_density_year_postcode(spark, d):
    """A-04: counts and counts per km2 by (year, postcode)."""
    return _density(spark, d, [YEAR(), "code_postal_id"])


@register("a05_top_category_year_postcode", with_ctes(R, AREAS_SQL, """
c AS (SELECT CAST(year(date_input) AS BIGINT) AS year, r.code_postal_id, category_FR, COUNT(id_dmr) AS count,
             COUNT(id_dmr) / ANY_VALUE(a.surface_km2) AS per_km2
      FROM reports r LEFT JOIN areas a ON r.code_postal_id = a.code_postal_id
      WHERE r.code_postal_id IS NOT NULL AND category_FR IS NOT NULL GROUP BY 1, 2, 3)""") + """
SELECT year, code_postal_id, category_FR, count, round(per_km2, 6) AS count_per_km2,
       FIRST_VALUE(category_FR) OVER (PARTITION BY year, code_postal_id ORDER BY count DESC, category_FR) AS top_category
FROM c""")
def a05_top_category_year_postcode(spark, d):
    """A-05 / W-04: per (year, postcode, category) counts, density and the group's top category."""
    c = _density(spark, d, [YEAR(), "code_postal_id", "category_FR"])
    return W.top_value_per_group(c, ["year", "code_postal_id"], "category_FR")


@register("a06_top_category_year_district", with_ctes(R, AREAS_SQL, """
c AS (SELECT CAST(year(date_input) AS BIGINT) AS year, r.code_postal_id, quartier_id, category_FR,
             COUNT(id_dmr) AS count, COUNT(id_dmr) / ANY_VALUE(a.surface_km2) AS per_km2
      FROM reports r LEFT JOIN areas a ON r.code_postal_id = a.code_postal_id
      WHERE r.code_postal_id IS NOT NULL AND quartier_id IS NOT NULL AND category_FR IS NOT NULL
      GROUP BY 1, 2, 3, 4)""") + """
SELECT year, code_postal_id, quartier_id, category_FR, count, round(per_km2, 6) AS count_per_km2,
       FIRST_VALUE(category_FR) OVER (PARTITION BY year, code_postal_id, quartier_id
                                      ORDER BY count DESC, category_FR) AS top_category
FROM c""")
def a06_top_category_year_district(spark, d):
    """A-06 / W-04: as A-05 with the district in the keys."""
    c = _density(spark, d, [YEAR(), "code_postal_id", "quartier_id", "category_FR"])
    return W.top_value_per_group(c, ["year", "code_postal_id", "quartier_id"], "category_FR")


@register("a07_count_weekend_subcategory", with_ctes(DETAILS_SQL) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
       CAST(isodow(date_input) > 5 AS BIGINT) AS weekend,
       code_postal_id, category_FR, subcategory_FR, COUNT(id_dmr) AS count
FROM details
WHERE code_postal_id IS NOT NULL AND category_FR IS NOT NULL AND subcategory_FR IS NOT NULL
GROUP BY ALL""")
def a07_count_weekend_subcategory(spark, d):
    """A-07: counts by (year, month, weekend flag, postcode, category, sub-category)."""
    det = _details(spark, d)
    keys = [YEAR(), MONTH(), dates.is_weekend(F.col("date_input")).cast("bigint").alias("weekend"),
            "code_postal_id", "category_FR", "subcategory_FR"]
    return A.count_by(det, keys, count_col="id_dmr", drop_null_keys=True)


@register("a08_count_dayofweek_subcategory", with_ctes(DETAILS_SQL) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
       CAST(isodow(date_input) - 1 AS BIGINT) AS dayofweek,
       code_postal_id, category_FR, subcategory_FR, COUNT(id_dmr) AS count
FROM details
WHERE code_postal_id IS NOT NULL AND category_FR IS NOT NULL AND subcategory_FR IS NOT NULL
GROUP BY ALL""")
def a08_count_dayofweek_subcategory(spark, d):
    """A-08: counts by (year, month, day of week Monday=0, postcode, category, sub-category)."""
    det = _details(spark, d)
    keys = [YEAR(), MONTH(), dates.day_of_week_monday0(F.col("date_input")).cast("bigint").alias("dayofweek"),
            "code_postal_id", "category_FR", "subcategory_FR"]
    return A.count_by(det, keys, count_col="id_dmr", drop_null_keys=True)


@register("a09_count_subcategory", with_ctes(DETAILS_SQL) + """
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
       code_postal_id, category_FR, subcategory_FR, COUNT(id_dmr) AS count
FROM details
WHERE code_postal_id IS NOT NULL AND category_FR IS NOT NULL AND subcategory_FR IS NOT NULL
GROUP BY ALL""")
def a09_count_subcategory(spark, d):
    """A-09: counts by (year, month, postcode, category, sub-category)."""
    return A.count_by(_details(spark, d), [YEAR(), MONTH(), "code_postal_id", "category_FR", "subcategory_FR"],
                      count_col="id_dmr", drop_null_keys=True)


@register("a10_count_etat_recent", with_ctes(R) + f"""
SELECT CAST(year(date_input) AS BIGINT) AS year, CAST(month(date_input) AS BIGINT) AS month,
       code_postal_id, quartier_id, category_FR, etat, COUNT(id_dmr) AS count
FROM reports
WHERE year(date_input) >= {RECENT_FROM_YEAR}
  AND code_postal_id IS NOT NULL AND quartier_id IS NOT NULL AND category_FR IS NOT NULL AND etat IS NOT NULL
GROUP BY ALL""")
def a10_count_etat_recent(spark, d):
    """A-10 / S-04: counts with status for the recent years (a date predicate on the scan)."""
    r = tables.reports(spark, d, date_from=f"{RECENT_FROM_YEAR}-01-01")
    return A.count_by(r, [YEAR(), MONTH(), "code_postal_id", "quartier_id", "category_FR", "etat"],
                      count_col="id_dmr", drop_null_keys=True)


@register("a22_rollup_postcodes", """
WITH pop AS (
  SELECT CAST(c_nationkey AS BIGINT) AS quartier_id, COUNT(*) AS population,
         CAST(0.75 AS DOUBLE) AS surface_km2
  FROM customer GROUP BY 1
), merged AS (
  SELECT CAST(-1 AS BIGINT) AS quartier_id, SUM(population) AS population, SUM(surface_km2) AS surface_km2
  FROM pop WHERE quartier_id IN (0, 1, 2, 3)
), allrows AS (SELECT * FROM pop UNION ALL SELECT * FROM merged)
SELECT quartier_id, population, round(surface_km2, 6) AS surface_km2,
       round(population / surface_km2, 6) AS density
FROM allrows""")
def a22_rollup_postcodes(spark, d):
    """A-22: districts 0-3 rolled into one new row (-1) by sum, density recomputed and appended."""
    cust = tables.read_table(spark, d, "customer")
    pop = cust.groupBy(F.col("c_nationkey").cast("bigint").alias("quartier_id")).agg(
        F.count(F.lit(1)).alias("population"))
    dist = tables.districts(spark, d).select("quartier_id", geo.area(F.col("geometry")).alias("surface_km2"))
    pop = pop.join(dist, "quartier_id", "inner")
    pop = pop.withColumn("density", F.col("population") / F.col("surface_km2"))
    return A.roll_up_rows(pop, "quartier_id", [0, 1, 2, 3], -1, ["population", "surface_km2"],
                          {"density": ("population", "surface_km2")})


@register("a25_median_delay_days", with_ctes(R, REPORT_LINES_SQL) + """
SELECT round(median(epoch(l.date_etat_ts) - epoch(CAST(r.date_input AS TIMESTAMP))) / 86400.0, 6) AS median
FROM reports r JOIN report_lines l ON r.id_dmr = l.id_dmr""")
def a25_median_delay_days(spark, d):
    """A-25 / D-03: exact median of the days between report and status date."""
    det = _reports(spark, d).join(tables.report_lines(spark, d), "id_dmr")
    det = det.withColumn("delta", dates.elapsed_days(F.col("date_input").cast("timestamp"), F.col("date_etat_ts")))
    return A.median_of(det, "delta")

"""Spatial jobs (SP-01..SP-17, A-15, J-11) over the district role polygons.

Role geometry (fixed): districts are L-shaped polygons built from ``nation``; parking
lots are squares around supplier points, parks are squares around customer points
(half side from the account balance), road arcs are 3-vertex lines starting at report
points. All of it is derived from the driver tables by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civlens.functions import geo
from civlens.operators import outline
from civlens.operators import spatial as S
from civlens.operators.aggregates import count_by
from civlens.operators.clustering import RADIUS_KM, dbscan
from civlens.plans.catalog import register
from civlens.sources import tables
from civlens.sources.tables import REPORTS_SQL, SHOPS_SQL, point_lat, point_lon, with_ctes

# District polygons are unit-sized; a quarter-unit grid gives 16 cells per district.
CELL = 0.25
rt = tables.read_table


def square(cx: Column, cy: Column, h: Column) -> Column:
    def p(dx, dy):
        return F.struct((cx + dx * h).alias("x"), (cy + dy * h).alias("y"))
    return F.array(F.array(F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1))))


def parking(spark, d):
    s = rt(spark, d, "supplier")
    h = F.lit(0.02) + F.abs(F.col("s_acctbal")) / F.lit(500000.0)
    return s.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("nation"),
                    square(point_lon(F.col("s_suppkey")), point_lat(F.col("s_suppkey")), h).alias("geometry"))


def parks(spark, d):
    c = rt(spark, d, "customer")
    h = F.lit(0.03) + F.abs(F.col("c_acctbal")) / F.lit(200000.0)
    return c.select("c_custkey", square(point_lon(F.col("c_custkey")), point_lat(F.col("c_custkey")), h).alias("geometry"))


def _districts(spark, d):
    return tables.districts(spark, d)


def georef_reports(spark, d):
    """SP-01: reports assigned to the first district containing them; unmatched keep their
    declared postcode and get a null district."""
    r = tables.reports(spark, d)
    a = S.assign_points(r, _districts(spark, d), ["quartier_id", "code_postal_id"], cell=CELL, how="left",
                        rank=F.col("quartier_id"))
    return a.select("id_dmr", "date_input", "etat", "category_FR", "lon", "lat",
                    F.col("poly_quartier_id").alias("quartier_id"),
                    F.coalesce(F.col("poly_code_postal_id"), F.col("code_postal_id")).alias("code_postal_id"))


def georef_shops(spark, d):
    """SP-02: shops assigned to districts in string order of the district id; unmatched dropped."""
    sh = tables.shops(spark, d)
    a = S.assign_points(sh, _districts(spark, d), ["quartier_id", "code_postal_id"], cell=CELL, how="inner",
                        rank=F.col("quartier_id").cast("string"))
    return a.withColumnRenamed("poly_quartier_id", "quartier_id").withColumnRenamed("poly_code_postal_id", "code_postal_id")


_L_INSIDE = """(x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND lon > x AND lon < x + 1 AND lat > y AND lat < y + 1
     AND NOT (lon >= x + 0.5 AND lat >= y + 0.5))"""

GEOREF_REPORTS_SQL = REPORTS_SQL + """,
g AS (SELECT *, floor(lon) AS x, floor(lat) AS y FROM reports),
m AS (SELECT *, CASE WHEN """ + _L_INSIDE + """ THEN CAST(x + 5 * y AS BIGINT) END AS q FROM g),
georef AS (SELECT m.id_dmr, m.q AS quartier_id, coalesce(CAST(n.n_regionkey AS BIGINT), m.code_postal_id) AS code_postal_id
           FROM m LEFT JOIN nation n ON m.q = n.n_nationkey)"""

GEOREF_SHOPS_SQL = SHOPS_SQL + """,
gs AS (SELECT *, floor(lon) AS x, floor(lat) AS y FROM shops),
ms AS (SELECT *, CAST(x + 5 * y AS BIGINT) AS q FROM gs WHERE """ + _L_INSIDE + """),
shop_georef AS (SELECT ms.id_, ms.category, ms.q AS quartier_id, CAST(n.n_regionkey AS BIGINT) AS code_postal_id
                FROM ms JOIN nation n ON ms.q = n.n_nationkey)"""


@register("sp01_assign_reports", with_ctes(GEOREF_REPORTS_SQL) + "SELECT * FROM georef")
def sp01_assign_reports(spark, d):
    """SP-01 / SP-06 / SP-11: point-in-polygon district assignment of every report."""
    return georef_reports(spark, d).select("id_dmr", "quartier_id", "code_postal_id")


@register("sp01_count_by_district", with_ctes(GEOREF_REPORTS_SQL) + """
SELECT quartier_id, COUNT(*) AS count FROM georef GROUP BY 1""")
def sp01_count_by_district(spark, d):
    """SP-01 then A-16: reports per assigned district (null = outside every district)."""
    return count_by(georef_reports(spark, d), ["quartier_id"])


@register("sp02_georef_shops", with_ctes(GEOREF_SHOPS_SQL) + "SELECT id_, quartier_id, code_postal_id FROM shop_georef")
def sp02_georef_shops(spark, d):
    """SP-02: shops kept only when inside a district, with its ids."""
    return georef_shops(spark, d).select("id_", "quartier_id", "code_postal_id")


@register("a15_shops_by_district", with_ctes(GEOREF_SHOPS_SQL) + """
SELECT category, quartier_id, code_postal_id, COUNT(id_) AS count_shops FROM shop_georef GROUP BY 1, 2, 3""")
def a15_shops_by_district(spark, d):
    """A-15: shops per (category, district, postcode)."""
    return count_by(georef_shops(spark, d), ["category", "quartier_id", "code_postal_id"], "count_shops", "id_")


@register("j11_reports_join_shops", with_ctes(GEOREF_REPORTS_SQL, GEOREF_SHOPS_SQL, """
cq AS (SELECT code_postal_id, quartier_id, COUNT(*) AS count FROM georef GROUP BY 1, 2),
sq AS (SELECT category, quartier_id, code_postal_id, COUNT(id_) AS count_shops FROM shop_georef GROUP BY 1, 2, 3)""") + """
SELECT cq.code_postal_id, cq.quartier_id, cq.count, sq.category, sq.quartier_id AS shops_quartier_id,
       sq.code_postal_id AS shops_code_postal_id, sq.count_shops
FROM cq LEFT JOIN sq ON cq.quartier_id = sq.quartier_id""")
def j11_reports_join_shops(spark, d):
    """J-11: reports per (postcode, district) left join shops per (category, district,
    postcode) on the district only (fans out by category); clashing names prefixed."""
    cq = count_by(georef_reports(spark, d), ["code_postal_id", "quartier_id"])
    sq = count_by(georef_shops(spark, d), ["category", "quartier_id", "code_postal_id"], "count_shops", "id_")
    sq = sq.withColumnRenamed("quartier_id", "shops_quartier_id").withColumnRenamed(
        "code_postal_id", "shops_code_postal_id")
    return cq.join(sq, cq.quartier_id == sq.shops_quartier_id, "left")


_PARKING_SQL = """
pk AS (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation,
              ((s_suppkey * 7919) % 100003 + 0.5) / 100003.0 * 5.4 - 0.2 AS lon,
              ((s_suppkey * 104729) % 100019 + 0.5) / 100019.0 * 5.4 - 0.2 AS lat,
              0.02 + abs(s_acctbal) / 500000.0 AS h FROM supplier)"""

_PARKS_SQL = """
pa AS (SELECT c_custkey,
              ((c_custkey * 7919) % 100003 + 0.5) / 100003.0 * 5.4 - 0.2 AS lon,
              ((c_custkey * 104729) % 100019 + 0.5) / 100019.0 * 5.4 - 0.2 AS lat,
              0.03 + abs(c_acctbal) / 200000.0 AS h FROM customer)"""


@register("sp03_parking_within_district", with_ctes(_PARKING_SQL, """
w AS (SELECT s_suppkey, floor(lon - h) AS x, floor(lat - h) AS y, lon, lat, h FROM pk)""") + """
SELECT s_suppkey, CASE WHEN x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND lon + h <= x + 1 AND lat + h <= y + 1
                        AND NOT (lon + h > x + 0.5 AND lat + h > y + 0.5)
                       THEN CAST(x + 5 * y AS BIGINT) END AS quartier_id
FROM w""")
def sp03_parking_within_district(spark, d):
    """SP-03: parking polygons assigned to the district that wholly contains them."""
    a = S.assign_geometries(parking(spark, d), _districts(spark, d), "s_suppkey", F.col("geometry"),
                            ["quartier_id"], predicate="within", cell=CELL)
    return a.select("s_suppkey", F.col("poly_quartier_id").alias("quartier_id"))


@register("sp04_parks_intersect_district", with_ctes(_PARKS_SQL, """
c AS (SELECT pa.c_custkey, n.n_nationkey AS q
      FROM pa JOIN nation n
        ON n.n_nationkey % 5 BETWEEN floor(pa.lon - pa.h) AND floor(pa.lon + pa.h)
       AND n.n_nationkey // 5 BETWEEN floor(pa.lat - pa.h) AND floor(pa.lat + pa.h)
      WHERE (pa.lon - pa.h <= n.n_nationkey % 5 + 1 AND pa.lon + pa.h >= n.n_nationkey % 5
             AND pa.lat - pa.h <= n.n_nationkey // 5 + 0.5 AND pa.lat + pa.h >= n.n_nationkey // 5)
         OR (pa.lon - pa.h <= n.n_nationkey % 5 + 0.5 AND pa.lon + pa.h >= n.n_nationkey % 5
             AND pa.lat - pa.h <= n.n_nationkey // 5 + 1 AND pa.lat + pa.h >= n.n_nationkey // 5))""") + """
SELECT pa.c_custkey, CAST(MIN(c.q) AS BIGINT) AS quartier_id
FROM pa LEFT JOIN c ON pa.c_custkey = c.c_custkey GROUP BY pa.c_custkey""")
def sp04_parks_intersect_district(spark, d):
    """SP-04 / SP-05: park polygons assigned to the first district they intersect."""
    a = S.assign_geometries(parks(spark, d), _districts(spark, d), "c_custkey", F.col("geometry"),
                            ["quartier_id"], predicate="intersects", cell=CELL)
    return a.select("c_custkey", F.col("poly_quartier_id").alias("quartier_id"))


@register("sp07_sampled_overlap")
def sp07_sampled_overlap(spark, d):
    """SP-07: parks matched to districts by 20 hashed sample points of their bounds; last match wins."""
    a = S.sampled_overlap(parks(spark, d), _districts(spark, d), "c_custkey", F.col("geometry"), ["quartier_id"],
                          n_samples=20, seed=7, cell=CELL)
    return a.select("c_custkey", F.col("poly_quartier_id").alias("quartier_id"))


def arcs(spark, d):
    """Road-arc role: a 3-vertex line starting at each report point."""
    r = tables.reports(spark, d)
    x, y = F.col("lon"), F.col("lat")
    line = F.array(geo.pt(x, y), geo.pt(x + 0.3, y + 0.2), geo.pt(x + 0.5, y - 0.1))
    return r.select(F.col("id_dmr").alias("arc_id"), line.alias("line"))


@register("sp08_line_length_in_district")
def sp08_line_length_in_district(spark, d):
    """SP-08 / SP-09: metres (UTM 31N) of each arc inside a district; last district wins."""
    out = S.line_length_in_polygons(arcs(spark, d), _districts(spark, d), "arc_id", "line", ["quartier_id"],
                                    cell=CELL, pick="last", project=True)
    return out.select("arc_id", F.col("poly_quartier_id").alias("quartier_id"), "length_in")


@register("sp10_sp11_geometry_stats", with_ctes(_PARKING_SQL) + """
SELECT s_suppkey, round(4 * h * h, 6) AS area, round(lon, 6) AS centroid_x, round(lat, 6) AS centroid_y,
       round(lon - h, 6) AS minx, round(lat - h, 6) AS miny, round(lon + h, 6) AS maxx, round(lat + h, 6) AS maxy
FROM pk""")
def sp10_sp11_geometry_stats(spark, d):
    """SP-10 / SP-11: area, centroid and bounds of every parking polygon."""
    p = parking(spark, d)
    g = F.col("geometry")
    c, b = geo.centroid(g), geo.bounds(g)
    return p.select("s_suppkey", geo.area(g).alias("area"), c["x"].alias("centroid_x"), c["y"].alias("centroid_y"),
                    b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


@register("sp12_dissolve", with_ctes(_PARKING_SQL) + """
SELECT nation AS key, round(SUM(4 * h * h), 6) AS area,
       round(SUM(4 * h * h * lon) / SUM(4 * h * h), 6) AS centroid_x,
       round(SUM(4 * h * h * lat) / SUM(4 * h * h), 6) AS centroid_y, COUNT(*) AS n_parts
FROM pk GROUP BY nation""")
def sp12_dissolve(spark, d):
    """SP-12: polygons grouped per key: area, centroid and number of parts."""
    diss = S.dissolve(parking(spark, d), F.col("nation"))
    return diss


@register("sp13_sp14_geojson_wkt_roundtrip", with_ctes(_PARKING_SQL) + """
SELECT s_suppkey, 'MultiPolygon' AS geojson_type, CAST(5 AS BIGINT) AS n_vertices, round(4 * h * h, 6) AS area,
       round(4 * h * h, 6) AS area_from_wkt, 'POLYGON' AS wkt_kind
FROM pk""")
def sp13_sp14_geojson_wkt_roundtrip(spark, d):
    """SP-13 / SP-14: geometry -> GeoJSON -> geometry -> WKT -> geometry, areas checked."""
    p = parking(spark, d).select("s_suppkey", geo.multipolygon_to_geojson(F.col("geometry")).alias("gj"))
    g = geo.geojson_to_multipolygon(F.col("gj"))
    p = p.select("s_suppkey", "gj", g.alias("g"))
    wkt = geo.multipolygon_to_wkt(F.col("g"))
    return p.select(
        "s_suppkey", geo.geojson_type(F.col("gj")).alias("geojson_type"),
        F.size(F.flatten(F.flatten("g"))).cast("bigint").alias("n_vertices"),
        geo.area(F.col("g")).alias("area"),
        geo.area(geo.wkt_polygon(wkt)).alias("area_from_wkt"),
        F.regexp_extract(wkt, r"^([A-Z]+)", 1).alias("wkt_kind"),
    )


@register("sp15_haversine", with_ctes(REPORTS_SQL, """
rc AS (SELECT r.id_dmr, r.lon, r.lat,
              ((o.o_custkey * 7919) % 100003 + 0.5) / 100003.0 * 5.4 - 0.2 AS clon,
              ((o.o_custkey * 104729) % 100019 + 0.5) / 100019.0 * 5.4 - 0.2 AS clat
       FROM reports r JOIN orders o ON r.id_dmr = o.o_orderkey)""") + """
SELECT id_dmr, round(2 * 6367.0 * asin(sqrt(pow(sin((radians(clat) - radians(lat)) / 2), 2)
        + cos(radians(lat)) * cos(radians(clat)) * pow(sin((radians(clon) - radians(lon)) / 2), 2))), 6) AS dist_km
FROM rc""")
def sp15_haversine(spark, d):
    """SP-15: great-circle km between each report and its customer's point."""
    r = tables.reports(spark, d)
    o = rt(spark, d, "orders").select(F.col("o_orderkey").alias("id_dmr"), "o_custkey")
    j = r.join(o, "id_dmr")
    dist = geo.haversine_km(F.col("lon"), F.col("lat"), point_lon(F.col("o_custkey")), point_lat(F.col("o_custkey")))
    return j.select("id_dmr", dist.alias("dist_km"))


_UTM_SQL = """
e AS (SELECT 1 / 298.257223563::DOUBLE AS f), c0 AS (SELECT f * (2 - f) AS e2 FROM e),
c1 AS (SELECT e2, e2 / (1 - e2) AS ep2 FROM c0),
p AS (SELECT id_dmr, radians(lat + 46.0) AS phi, radians(lon) - radians(3.0) AS lam, e2, ep2 FROM reports, c1),
q AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t,
             ep2 * cos(phi) * cos(phi) AS c, cos(phi) * lam AS a,
             6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * phi
               - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * phi)
               + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * phi)
               - (35 * e2 * e2 * e2 / 3072) * sin(6 * phi)) AS m FROM p)"""


@register("sp09_utm_projection", with_ctes(REPORTS_SQL, _UTM_SQL) + """
SELECT id_dmr,
       round(0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6
             + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(a, 5) / 120) + 500000.0, 3) AS x_m,
       round(0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24
             + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pow(a, 6) / 720)), 3) AS y_m
FROM q""")
def sp09_utm_projection(spark, d):
    """SP-09: report points projected to UTM zone 31N, in metres to the millimetre."""
    r = tables.reports(spark, d)
    p = geo.utm31(F.col("lon"), F.col("lat") + F.lit(46.0))
    return r.select("id_dmr", F.round(p["x"], 3).alias("x_m"), F.round(p["y"], 3).alias("y_m"))


_HEX = (-0.2, -0.2, 5.2, 5.2)


@register("sp17_hexbin_counts", with_ctes(REPORTS_SQL, """
h AS (SELECT (lon + 0.2) / (5.4 / 10 / sqrt(3.0)) AS px, (lat + 0.2) / (5.4 / 10 / sqrt(3.0)) AS py FROM reports),
c AS (SELECT sqrt(3.0) / 3.0 * px - 1.0 / 3.0 * py AS qf, 2.0 / 3.0 * py AS rf FROM h),
r AS (SELECT qf, rf, -qf - rf AS sf, round(qf) AS q, round(rf) AS r, round(-qf - rf) AS s FROM c),
k AS (SELECT CASE WHEN abs(q - qf) > abs(r - rf) AND abs(q - qf) > abs(s - sf) THEN -r - s ELSE q END AS hq,
             CASE WHEN abs(q - qf) > abs(r - rf) AND abs(q - qf) > abs(s - sf) THEN r
                  WHEN abs(r - rf) > abs(s - sf) THEN -q - s ELSE r END AS hr FROM r)""") + """
SELECT CAST(hq AS BIGINT) AS hex_q, CAST(hr AS BIGINT) AS hex_r, COUNT(*) AS count FROM k GROUP BY 1, 2""")
def sp17_hexbin_counts(spark, d):
    """SP-17: report counts per hexagon (10 across the extent, min count 1)."""
    return S.hexbin_counts(tables.reports(spark, d), "lon", "lat", _HEX, nx_hexagon=10, min_count=1)


# Fixed role: a customer lives in a box around the middle of its nation's district.
EPS_KM, MIN_SAMPLES = 8.0, 4


@register("sp16_dbscan", f"""
WITH RECURSIVE homes AS (
  SELECT c_custkey AS id, radians(c_nationkey // 5 + 0.1 + 0.8 * ((c_custkey * 7919) % 1009) / 1009.0) AS lat,
         radians(c_nationkey % 5 + 0.5 + c_acctbal / 25000.0) AS lon
  FROM customer),
near AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM homes a JOIN homes b
  ON b.lat BETWEEN a.lat - {EPS_KM / 6371} AND a.lat + {EPS_KM / 6371}
  WHERE pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2)
        <= pow(sin({EPS_KM} / {RADIUS_KM} / 2), 2)),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING COUNT(*) >= {MIN_SAMPLES}),
links AS MATERIALIZED (SELECT n.a, n.b FROM near n JOIN core x ON n.a = x.id JOIN core y ON n.b = y.id),
reach(id, root) AS (
  SELECT id, id FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
clusters AS (SELECT id, MIN(root) AS cluster FROM reach GROUP BY id)
SELECT h.id, COALESCE(MIN(c.cluster), -1) AS cluster
FROM homes h JOIN near n ON n.a = h.id LEFT JOIN clusters c ON c.id = n.b GROUP BY h.id""")
def sp16_dbscan(spark, d):
    """SP-16: density clusters of customers' homes by great-circle distance; noise is -1."""
    c = rt(spark, d, "customer")
    lat = F.floor(F.col("c_nationkey") / 5) + 0.1 + 0.8 * ((F.col("c_custkey") * 7919) % 1009) / 1009.0
    lon = F.col("c_nationkey") % 5 + 0.5 + F.col("c_acctbal") / 25000.0
    homes = c.select(F.col("c_custkey").alias("id"), lat.alias("lat"), lon.alias("lon"))
    return dbscan(homes, "id", "lat", "lon", EPS_KM, MIN_SAMPLES).select("id", "cluster")


# Fixed role: the area of a status is made of the grid squares that hold a report of it.
SQUARES = 50.0  # a degree


@register("sp12_union_outline", with_ctes(REPORTS_SQL, f"""
held AS (
  SELECT DISTINCT etat AS key, CAST(floor(lon * {SQUARES}) AS BIGINT) AS x, CAST(floor(lat * {SQUARES}) AS BIGINT) AS y
  FROM reports)""", """
near AS (
  SELECT h.key, COUNT(o.x) AS shared FROM held h
  LEFT JOIN (SELECT key, x + dx AS x, y + dy AS y
             FROM held, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS side(dx, dy)) o
  ON o.key = h.key AND o.x = h.x AND o.y = h.y GROUP BY h.key)""") + """
SELECT h.key, CAST(COUNT(*) AS DOUBLE) AS area, CAST(4 * COUNT(*) - MIN(n.shared) AS DOUBLE) AS perimeter
FROM held h JOIN near n ON n.key = h.key GROUP BY h.key""")
def sp12_union_outline(spark, d):
    """SP-12: outline of the union of grid squares per status: area and perimeter, in squares."""
    r = tables.reports(spark, d)
    held = r.select("etat", F.floor(F.col("lon") * SQUARES).alias("x"), F.floor(F.col("lat") * SQUARES).alias("y")).distinct()
    squares = held.select("etat", square(F.col("x") + 0.5, F.col("y") + 0.5, F.lit(0.5)).alias("geometry"))
    return outline.measures(outline.outline(squares, F.col("etat"))).select("key", "area", "perimeter")


@register("sp12_union_districts", """
WITH held AS (
  SELECT n_regionkey AS key, 2 * (n_nationkey % 5) + dx AS x, 2 * (n_nationkey // 5) + dy AS y
  FROM nation, (VALUES (0, 0), (1, 0), (0, 1)) AS quarter(dx, dy)),
near AS (
  SELECT h.key, COUNT(*) AS shared FROM held h JOIN held o
  ON o.key = h.key AND abs(o.x - h.x) + abs(o.y - h.y) = 1 GROUP BY h.key)
SELECT CAST(h.key AS BIGINT) AS key, COUNT(*) * 0.25 AS area, (4 * COUNT(*) - COALESCE(MIN(n.shared), 0)) * 0.5 AS perimeter
FROM held h LEFT JOIN near n ON n.key = h.key GROUP BY h.key""")
def sp12_union_districts(spark, d):
    """SP-12: outline of the union of the districts of each postcode."""
    return outline.measures(outline.outline(_districts(spark, d), F.col("code_postal_id"))).select("key", "area", "perimeter")


@register("s18_merged_feature", """
SELECT CASE WHEN n_nationkey < 4 THEN n_nationkey || '_OLD' ELSE CAST(n_nationkey AS VARCHAR) END AS c_ar, n_name AS l_ar,
       0.75 AS surface, 0.75 AS area FROM nation
UNION ALL
SELECT '1', 'Centre', 0.75 * COUNT(*), 0.75 * COUNT(*) FROM nation WHERE n_nationkey < 4""")
def s18_merged_feature(spark, d):
    """S-18: features of the districts, the first four renamed and merged into a new one."""
    of = _districts(spark, d).select(
        F.col("quartier_id").cast("string").alias("c_ar"), F.col("name").alias("l_ar"), geo.area(F.col("geometry")).alias("surface"), "geometry"
    )
    out = outline.merge_features(of, "c_ar", ["0", "1", "2", "3"], "1", {"l_ar": "Centre"}, "surface")
    return out.select("c_ar", "l_ar", "surface", geo.area(F.col("geometry")).alias("area"))

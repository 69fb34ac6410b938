"""Geometry as Spark columns, evaluated with SQL higher-order functions.

Representation (no geometry library is needed on the executors):
  point         two double columns (x = lon, y = lat)
  line          ARRAY<STRUCT<x DOUBLE, y DOUBLE>>
  ring          closed line (first point == last point)
  polygon       ARRAY<ring>, the first ring is the shell, the others are holes
  multipolygon  ARRAY<polygon>; every polygon column of this library is a multipolygon

Every function returns a Column; the work runs inside Spark tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_T = "struct<x:double,y:double>"
LINE_T = f"array<{POINT_T}>"
MULTIPOLYGON_T = f"array<array<{LINE_T}>>"


def pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edges(ring: Column, fn, zero: Column, merge=lambda a, b: a + b) -> Column:
    """Fold ``fn(p, q)`` over consecutive vertex pairs of a line/ring."""
    n = F.size(ring)
    idx = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    return F.when(
        n >= 2,
        F.aggregate(idx, zero, lambda acc, i: merge(acc, fn(F.get(ring, i), F.get(ring, i + 1)))),
    ).otherwise(zero)


def _any_edge(ring: Column, pred) -> Column:
    n = F.size(ring)
    idx = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    return (n >= 2) & F.exists(idx, lambda i: pred(F.get(ring, i), F.get(ring, i + 1)))


def _all_rings(mp: Column) -> Column:
    return F.flatten(mp)


# ---------------------------------------------------------------- bounds, area, centroid


def bounds(mp: Column) -> Column:
    """SP-11: struct(minx, miny, maxx, maxy) of a multipolygon."""
    pts = F.flatten(F.flatten(mp))
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def line_bounds(line: Column) -> Column:
    xs = F.transform(line, lambda p: p["x"])
    ys = F.transform(line, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def ring_signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"], F.lit(0.0)) / F.lit(2.0)


def polygon_area(poly: Column) -> Column:
    """Shell area minus hole areas (orientation free)."""
    return F.aggregate(
        F.transform(poly, lambda r, k: F.when(k == 0, F.abs(ring_signed_area(r))).otherwise(-F.abs(ring_signed_area(r)))),
        F.lit(0.0),
        lambda a, b: a + b,
    )


def area(mp: Column) -> Column:
    """Planar area of a multipolygon, in squared coordinate units."""
    return F.aggregate(F.transform(mp, polygon_area), F.lit(0.0), lambda a, b: a + b)


def _ring_moments(ring: Column) -> Column:
    """struct(a, mx, my): signed area and signed first moments of a ring."""
    a = ring_signed_area(ring)
    mx = _edges(ring, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0)) / F.lit(6.0)
    my = _edges(ring, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0)) / F.lit(6.0)
    return F.struct(a.alias("a"), mx.alias("mx"), my.alias("my"))


def centroid(mp: Column) -> Column:
    """SP-10: area-weighted centroid of a multipolygon (holes subtract)."""
    rings = F.flatten(F.transform(mp, lambda poly: F.transform(
        poly, lambda r, k: F.struct(_ring_moments(r).alias("m"), F.when(k == 0, 1.0).otherwise(-1.0).alias("s")))))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, e):
        sgn = F.signum(e["m"]["a"]) * e["s"]
        return F.struct(
            (acc["a"] + F.abs(e["m"]["a"]) * e["s"]).alias("a"),
            (acc["mx"] + e["m"]["mx"] * sgn).alias("mx"),
            (acc["my"] + e["m"]["my"] * sgn).alias("my"),
        )

    tot = F.aggregate(rings, zero, add)
    return F.struct(F.try_divide(tot["mx"], tot["a"]).alias("x"), F.try_divide(tot["my"], tot["a"]).alias("y"))


def line_length(line: Column) -> Column:
    return _edges(line, lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2), F.lit(0.0))


def line_centroid(line: Column) -> Column:
    """SP-10 for lines: length-weighted mean of segment midpoints (first point if length 0)."""
    seg = lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2)
    sx = _edges(line, lambda p, q: seg(p, q) * (p["x"] + q["x"]) / 2.0, F.lit(0.0))
    sy = _edges(line, lambda p, q: seg(p, q) * (p["y"] + q["y"]) / 2.0, F.lit(0.0))
    length = line_length(line)
    first = F.get(line, 0)
    return F.when(length > 0, F.struct((sx / length).alias("x"), (sy / length).alias("y"))).otherwise(first)


def points_centroid(points: Column) -> Column:
    """SP-10 for multipoints: mean of the points."""
    n = F.size(points)
    sx = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["x"])
    sy = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["y"])
    return F.struct((sx / n).alias("x"), (sy / n).alias("y"))


# ---------------------------------------------------------------- point in polygon


def _crosses_ray(p: Column, q: Column, x: Column, y: Column) -> Column:
    """Edge p-q crosses the horizontal ray going right from (x, y) (half-open rule)."""
    straddles = (p["y"] > y) != (q["y"] > y)
    x_at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
    return straddles & (x < x_at)


def _on_segment(p: Column, q: Column, x: Column, y: Column, eps: float = 1e-12) -> Column:
    cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
    within = (
        (x >= F.least(p["x"], q["x"]) - eps) & (x <= F.greatest(p["x"], q["x"]) + eps)
        & (y >= F.least(p["y"], q["y"]) - eps) & (y <= F.greatest(p["y"], q["y"]) + eps)
    )
    return (F.abs(cross) <= F.lit(eps)) & within


def ring_crossings(ring: Column, x: Column, y: Column) -> Column:
    return _edges(ring, lambda p, q: F.when(_crosses_ray(p, q, x, y), 1).otherwise(0), F.lit(0))


def on_boundary(mp: Column, x: Column, y: Column) -> Column:
    return F.exists(_all_rings(mp), lambda r: _any_edge(r, lambda p, q: _on_segment(p, q, x, y)))


def contains_point(mp: Column, x: Column, y: Column, strict: bool = True) -> Column:
    """Even-odd ray casting over every polygon of the multipolygon.

    ``strict`` (default) leaves points on the boundary outside, like a ``contains``
    predicate (Q-04). Null coordinates give null.
    """
    inside = F.exists(
        mp, lambda poly: (F.aggregate(F.transform(poly, lambda r: ring_crossings(r, x, y)), F.lit(0), lambda a, b: a + b) % 2) == 1
    )
    if strict:
        inside = inside & ~on_boundary(mp, x, y)
    else:
        inside = inside | on_boundary(mp, x, y)
    return F.when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), F.lit(None).cast("boolean")).otherwise(inside)


def in_bounds(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["minx"]) & (x <= b["maxx"]) & (y >= b["miny"]) & (y <= b["maxy"])


# ---------------------------------------------------------------- segment predicates


def _orient(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def segments_cross(p1: Column, p2: Column, q1: Column, q2: Column) -> Column:
    """Proper crossing (interiors cross at one point, no touching)."""
    o1, o2 = _orient(p1, p2, q1), _orient(p1, p2, q2)
    o3, o4 = _orient(q1, q2, p1), _orient(q1, q2, p2)
    return (o1 * o2 < 0) & (o3 * o4 < 0)


def _edges_cross_any(line: Column, mp: Column) -> Column:
    return _any_edge(line, lambda p, q: F.exists(_all_rings(mp), lambda r: _any_edge(r, lambda a, b: segments_cross(p, q, a, b))))


def polygon_within(inner: Column, outer: Column) -> Column:
    """SP-03: no part of ``inner`` lies outside ``outer``: each of its rings runs inside or on the
    border all along, and no hole of ``outer`` has a corner strictly inside it."""
    edges = polygon_edges(outer)

    def runs_inside(ring):
        length = line_length(ring)
        return clipped_length(ring, outer, edges) >= length * (1 - 1e-9)

    holes = F.flatten(F.transform(outer, lambda poly: F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0)))))
    corners = F.flatten(holes)
    return F.forall(_all_rings(inner), runs_inside) & ~F.exists(
        corners, lambda v: contains_point(inner, v["x"], v["y"], strict=True)
    )


def polygons_intersect(a: Column, b: Column) -> Column:
    """SP-04: the two areas share a point: an edge crossing, or a vertex of one inside the
    other."""
    va = F.flatten(F.flatten(a))
    vb = F.flatten(F.flatten(b))
    return (
        F.exists(_all_rings(a), lambda r: _edges_cross_any(r, b))
        | F.exists(va, lambda v: contains_point(b, v["x"], v["y"], strict=False))
        | F.exists(vb, lambda v: contains_point(a, v["x"], v["y"], strict=False))
    )


# ---------------------------------------------------------------- distances, projection

EARTH_RADIUS_KM_HAVERSINE = 6367.0
EARTH_RADIUS_KM_MEAN = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_KM_HAVERSINE) -> Column:
    """SP-15: great-circle distance in km."""
    lo1, la1, lo2, la2 = (F.radians(c) for c in (lon1, lat1, lon2, lat2))
    a = F.sin((la2 - la1) / 2) ** 2 + F.cos(la1) * F.cos(la2) * F.sin((lo2 - lo1) / 2) ** 2
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


# WGS84 ellipsoid and UTM zone 31N (EPSG:32631) parameters.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM31_CENTRAL_MERIDIAN_DEG = 3.0


def _utm_angles(lon: Column, lat: Column) -> Column:
    phi = F.radians(lat)
    lam = F.radians(lon) - F.lit(math.radians(UTM31_CENTRAL_MERIDIAN_DEG))
    return F.struct(phi.alias("phi"), lam.alias("lam"), F.sin(phi).alias("sin"), F.cos(phi).alias("cos"), F.tan(phi).alias("tan"))


def _utm_terms(s: Column) -> Column:
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi, lam, sin_p, cos_p, tan_p = (s[c] for c in ("phi", "lam", "sin", "cos", "tan"))
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(e2) * sin_p * sin_p)
    m = F.lit(WGS84_A) * (
        F.lit(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - F.lit(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + F.lit(15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - F.lit(35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    return F.struct(n.alias("n"), (tan_p * tan_p).alias("t"), (F.lit(ep2) * cos_p * cos_p).alias("c"), (cos_p * lam).alias("a"), m.alias("m"), tan_p.alias("tan"))


def _utm_point(s: Column) -> Column:
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    n, t, c, a, m, tan_p = (s[x] for x in ("n", "t", "c", "a", "m", "tan"))
    x = F.lit(UTM_K0) * n * (
        a + (F.lit(1.0) - t + c) * a**3 / 6 + (F.lit(5.0) - 18 * t + t * t + 72 * c - F.lit(58 * ep2)) * a**5 / 120
    ) + F.lit(UTM_FALSE_EASTING)
    y = F.lit(UTM_K0) * (
        m + n * tan_p * (a * a / 2 + (F.lit(5.0) - t + 9 * c + 4 * c * c) * a**4 / 24
                         + (F.lit(61.0) - 58 * t + t * t + 600 * c - F.lit(330 * ep2)) * a**6 / 720)
    )
    return F.struct(x.alias("x"), y.alias("y"))


def utm31(lon: Column, lat: Column) -> Column:
    """SP-09: EPSG:4326 (lon, lat) -> EPSG:32631 metres, transverse Mercator series
    (Snyder's formulas; sub-metre within the zone)."""
    return _utm_point(_utm_terms(_utm_angles(lon, lat)))


def project_line(line: Column) -> Column:
    """``utm31`` of each point, in stages: no term is computed twice."""
    return F.transform(F.transform(F.transform(line, lambda p: _utm_angles(p["x"], p["y"])), _utm_terms), _utm_point)


def project_multipolygon(mp: Column) -> Column:
    return F.transform(mp, lambda poly: F.transform(poly, project_line))


def polygon_edges(mp: Column) -> Column:
    """All edges of a multipolygon as ARRAY<STRUCT<a, b>>."""
    return F.flatten(F.transform(_all_rings(mp), lambda r: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))),
        lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, i + 1).alias("b")))))


def clipped_length(line: Column, mp: Column, edges: Column | None = None) -> Column:
    """SP-08: length of the part of ``line`` inside ``mp`` (same planar units).

    Each segment is cut at its crossings with every polygon edge; a piece counts when its
    midpoint lies inside (boundary included). Work is staged through arrays of structs
    (segments -> segments with sorted cut parameters -> piece lengths) so that no
    sub-expression is re-evaluated inside the lambdas. Pass ``edges`` (from
    ``polygon_edges``) as a column to avoid rebuilding it per row.
    """
    edges = edges if edges is not None else polygon_edges(mp)
    n = F.size(line)
    segs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
                       lambda i: F.struct(F.get(line, i).alias("p"), F.get(line, i + 1).alias("q")))

    def with_cuts(s):
        p, q = s["p"], s["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]

        def t_of(e):
            ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
            den = dx * ey - dy * ex
            t = ((e["a"]["x"] - p["x"]) * ey - (e["a"]["y"] - p["y"]) * ex) / den
            u = ((e["a"]["x"] - p["x"]) * dy - (e["a"]["y"] - p["y"]) * dx) / den
            return F.when((den != 0) & (u >= 0) & (u <= 1) & (t > 0) & (t < 1), t)

        cuts = F.filter(F.transform(edges, t_of), lambda t: t.isNotNull())
        ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
        return F.struct(p.alias("p"), dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("len"),
                        ts.alias("ts"))

    def seg_inside(s):
        ts = s["ts"]
        pieces = F.transform(F.sequence(F.lit(0), F.size(ts) - 2),
                             lambda i: F.struct(F.get(ts, i).alias("t0"), F.get(ts, i + 1).alias("t1")))

        def piece_len(pc):
            tm = (pc["t0"] + pc["t1"]) / 2
            inside = contains_point(mp, s["p"]["x"] + s["dx"] * tm, s["p"]["y"] + s["dy"] * tm, strict=False)
            return F.when(inside, (pc["t1"] - pc["t0"]) * s["len"]).otherwise(F.lit(0.0))

        return F.aggregate(F.transform(pieces, piece_len), F.lit(0.0), lambda a, b: a + b)

    staged = F.transform(F.transform(segs, with_cuts), seg_inside)
    return F.when(n >= 2, F.aggregate(staged, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def flat_points(line: Column) -> Column:
    """x, y of all points of a line as one array."""
    return F.flatten(F.transform(line, lambda p: F.array(p["x"], p["y"])))


def flat_edges(mp: Column) -> Column:
    """Number of the polygon, ax, ay, bx, by of all edges of a multipolygon as one array."""
    flat = lambda k, e: F.array(k.cast("double"), e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])
    return F.flatten(F.flatten(F.transform(mp, lambda poly, k: F.transform(polygon_edges(F.array(poly)), lambda e: flat(k, e)))))


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, each ``n`` times, and the numbers first, first + 1, ... beside them."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _clipped(lines: Sequence[np.ndarray], edges: Sequence[np.ndarray], eps: float = 1e-12) -> np.ndarray:
    """``clipped_length`` of each line and the multipolygon beside it, from flat points and edges."""
    points, per = np.concatenate(lines).astype(float).reshape(-1, 2), np.array([len(x) // 2 for x in lines])
    poly, ax, ay, bx, by = np.concatenate(edges).astype(float).reshape(-1, 5).T
    sides = np.array([len(x) // 5 for x in edges])
    start = np.cumsum(sides) - sides
    with np.errstate(all="ignore"):
        of, p = _spread(np.cumsum(per) - per, np.maximum(per - 1, 0))  # segments: line, first point
        (px, py), (qx, qy) = points[p].T, points[p + 1].T
        dx, dy = qx - px, qy - py
        seg, e = _spread(start[of], sides[of])
        ex, ey = bx[e] - ax[e], by[e] - ay[e]
        den = dx[seg] * ey - dy[seg] * ex
        t = ((ax[e] - px[seg]) * ey - (ay[e] - py[seg]) * ex) / den
        u = ((ax[e] - px[seg]) * dy[seg] - (ay[e] - py[seg]) * dx[seg]) / den
        cut = (den != 0) & (u >= 0) & (u <= 1) & (t > 0) & (t < 1)
        every = np.arange(len(of))
        s, t = np.concatenate([every, every, seg[cut]]), np.concatenate([np.zeros(len(of)), np.ones(len(of)), t[cut]])
        order = np.lexsort((t, s))
        s, t = s[order], t[order]
        whole = np.flatnonzero(s[1:] == s[:-1])  # a piece lies between two cuts of a segment
        s, t0, t1 = s[whole], t[whole], t[whole + 1]
        mid = (t0 + t1) / 2
        x, y = px[s] + dx[s] * mid, py[s] + dy[s] * mid
        piece, e = _spread(start[of[s]], sides[of[s]])
        ex, ey, x, y = bx[e] - ax[e], by[e] - ay[e], x[piece], y[piece]
        crosses = ((ay[e] > y) != (by[e] > y)) & (x < ex * (y - ay[e]) / ey + ax[e])
        near = (x >= np.minimum(ax[e], bx[e]) - eps) & (x <= np.maximum(ax[e], bx[e]) + eps)
        near &= (y >= np.minimum(ay[e], by[e]) - eps) & (y <= np.maximum(ay[e], by[e]) + eps)
        near &= np.abs(ex * (y - ay[e]) - ey * (x - ax[e])) <= eps
        inside = np.bincount(piece[near], minlength=len(s)) > 0
        if len(piece):
            runs = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (poly[e][1:] != poly[e][:-1])]))
            odd = np.add.reduceat(crosses.astype(int), runs) % 2 == 1
            inside[piece[runs[odd]]] = True
        length = np.where(inside, (t1 - t0) * np.sqrt(dx * dx + dy * dy)[s], 0.0)
    return np.bincount(of[s], length, minlength=len(per))


#: Lines that are clipped at once.
CLIPPED = 4096


def _clipped_rows(lines: pd.Series, edges: pd.Series) -> pd.Series:
    steps = range(0, len(lines), CLIPPED)
    return pd.Series(np.concatenate([np.zeros(0), *[_clipped(lines[k : k + CLIPPED].to_list(), edges[k : k + CLIPPED].to_list()) for k in steps]]))


def clipped_lengths(lines: Column, edges: Column) -> Column:
    """SP-08: ``clipped_length`` from ``flat_points`` and ``flat_edges``, many rows at a time."""
    return F.pandas_udf(_clipped_rows, "double")(lines, edges)


# ---------------------------------------------------------------- GeoJSON and WKT


def _to_pts(arr: Column) -> Column:
    return F.transform(arr, lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y")))


def geojson_type(txt: Column) -> Column:
    return F.get_json_object(txt, "$.type")


def geojson_to_multipolygon(txt: Column) -> Column:
    """SP-13 (safe): GeoJSON Polygon / MultiPolygon text -> multipolygon; null otherwise."""
    t = geojson_type(txt)
    coords = F.get_json_object(txt, "$.coordinates")
    poly = F.from_json(coords, "array<array<array<double>>>")
    mpoly = F.from_json(coords, "array<array<array<array<double>>>>")
    as_poly = F.transform(poly, _to_pts)
    return (
        F.when(t == "Polygon", F.array(as_poly))
        .when(t == "MultiPolygon", F.transform(mpoly, lambda p: F.transform(p, _to_pts)))
    )


def geojson_to_lines(txt: Column) -> Column:
    """GeoJSON LineString or MultiLineString -> ARRAY<line>; null otherwise."""
    t = geojson_type(txt)
    coords = F.get_json_object(txt, "$.coordinates")
    return (
        F.when(t == "LineString", F.array(_to_pts(F.from_json(coords, "array<array<double>>"))))
        .when(t == "MultiLineString", F.transform(F.from_json(coords, "array<array<array<double>>>"), _to_pts))
    )


def lines_length(lines: Column) -> Column:
    """Sum of the lengths of the parts; nothing between them counts."""
    return F.aggregate(F.transform(lines, line_length), F.lit(0.0), lambda a, b: a + b)


def _fmt(v: Column) -> Column:
    return v.cast("double").cast("string")  # shortest round-trip text of the double


def _wkt_coords(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda p: F.concat(_fmt(p["x"]), F.lit(" "), _fmt(p["y"]))), ", ")


def _wkt_poly(poly: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(poly, lambda r: F.concat(F.lit("("), _wkt_coords(r), F.lit(")"))), ", "), F.lit(")"))


def multipolygon_to_wkt(mp: Column) -> Column:
    """SP-14: POLYGON when there is one polygon, MULTIPOLYGON otherwise."""
    return F.when(F.size(mp) == 1, F.concat(F.lit("POLYGON "), _wkt_poly(F.get(mp, 0)))).otherwise(
        F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(mp, _wkt_poly), ", "), F.lit(")"))
    )


def point_to_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), _fmt(x), F.lit(" "), _fmt(y), F.lit(")"))


def multipoint_to_wkt(points: Column) -> Column:
    each = F.transform(points, lambda p: F.concat(F.lit("("), _fmt(p["x"]), F.lit(" "), _fmt(p["y"]), F.lit(")")))
    return F.concat(F.lit("MULTIPOINT ("), F.array_join(each, ", "), F.lit(")"))


def wkt_polygon(txt: Column) -> Column:
    """SP-14 read: POLYGON or MULTIPOLYGON text -> multipolygon; null otherwise."""
    kind = F.upper(F.regexp_extract(txt, r"^\s*(\w+)", 1))
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    pairs = F.regexp_replace(F.regexp_replace(txt, r"^\s*\w+\s*", ""), rf"({number})\s+({number})", "[$1,$2]")
    coords = F.translate(pairs, "()", "[]")
    poly = F.from_json(coords, "array<array<array<double>>>")
    mpoly = F.from_json(coords, "array<array<array<array<double>>>>")
    return (
        F.when(kind == "POLYGON", F.array(F.transform(poly, _to_pts)))
        .when(kind == "MULTIPOLYGON", F.transform(mpoly, lambda p: F.transform(p, _to_pts)))
    )


def multipolygon_to_geojson(mp: Column) -> Column:
    coords = F.transform(mp, lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))


# ---------------------------------------------------------------- grid cells


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("bigint")


def cell_range(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(cell_of(lo, size), cell_of(hi, size))

"""Spatial operators (SP-01..SP-17) as grid-keyed equi joins.

Point-in-polygon assignment without a nested-loop join:
  1. every polygon is exploded over the grid cells of its bounding box;
  2. per cell, the candidate polygons are kept as one small array sorted by rank
     (the "first match wins" order of the reference, SP-06);
  3. each point is equi-joined to the single row of its cell, and the first candidate
     whose bounds and ring test accept the point is picked with ``filter(...)[0]``.

Step 3 is a projection after a join that never fans out (one row per cell), so no
further shuffle is needed to pick the match. The join on the cell key is planned by Spark
(a small cell table is broadcast, skewed cells of a large one are split).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlens.functions import geo



def polygon_cells(
    polygons: DataFrame,
    geom: str,
    cell: float,
    payload: Sequence[str],
    rank: Column,
) -> DataFrame:
    """(cx, cy) -> sorted array of candidate polygons struct(rank, payload..., b, g)."""
    b = geo.bounds(F.col(geom))
    base = polygons.where(F.col(geom).isNotNull()).select(
        rank.alias("rank"), *[F.col(c) for c in payload], F.col(geom).alias("g"), b.alias("b")
    )
    ex = base.withColumn("cx", F.explode(geo.cell_range(F.col("b.minx"), F.col("b.maxx"), cell))).withColumn(
        "cy", F.explode(geo.cell_range(F.col("b.miny"), F.col("b.maxy"), cell))
    )
    cand = F.struct("rank", *payload, "b", "g")
    return ex.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(cand)).alias("cands"))


def _join_cells(df: DataFrame, cells: DataFrame, cx: Column, cy: Column, how: str) -> DataFrame:
    keyed = df.withColumn("__cx", cx).withColumn("__cy", cy)
    cells = cells.withColumnRenamed("cx", "__cx").withColumnRenamed("cy", "__cy")
    return keyed.join(cells, ["__cx", "__cy"], how)


def assign_points(
    points: DataFrame,
    polygons: DataFrame,
    payload: Sequence[str],
    geom: str = "geometry",
    rank: Column | None = None,
    lon: str = "lon",
    lat: str = "lat",
    cell: float = 0.01,
    how: str = "left",
    strict: bool = True,
    prefix: str = "poly_",
) -> DataFrame:
    """SP-01 / SP-02 / SP-06: each point gets the payload of the first polygon (by
    ``rank``) that contains it. ``how='left'`` keeps unmatched points with nulls,
    ``how='inner'`` drops them. Output payload columns are named ``prefix + name``."""
    rank = rank if rank is not None else F.col(payload[0])
    cells = polygon_cells(polygons, geom, cell, payload, rank)
    x, y = F.col(lon), F.col(lat)
    joined = _join_cells(points, cells, geo.cell_of(x, cell), geo.cell_of(y, cell), "left")
    hit = F.get(
        F.filter(F.col("cands"), lambda c: geo.in_bounds(c["b"], x, y) & geo.contains_point(c["g"], x, y, strict)), 0
    )
    out = joined.withColumn("__hit", hit)
    if how == "inner":
        out = out.where(F.col("__hit").isNotNull())
    return out.select(
        *[F.col(f"`{c}`") for c in points.columns],
        *[F.col("__hit")[c].alias(prefix + c) for c in payload],
    )


def _picked(joined: DataFrame, key: str, hits: Column, payload: Sequence[str], pick: str) -> DataFrame:
    """key and ``__hit``, the first or last of its ``hits`` by rank: only rank and payload travel on."""
    slim = F.transform(F.filter(hits, lambda c: c["rank"].isNotNull()), lambda c: F.struct(c["rank"], *[c[p] for p in payload]))
    one, best = (F.array_min, F.min) if pick == "first" else (F.array_max, F.max)
    found = joined.select(key, one(slim).alias("__hit")).where(F.col("__hit").isNotNull())
    return found.groupBy(key).agg(best("__hit").alias("__hit"))


def assign_geometries(
    items: DataFrame,
    polygons: DataFrame,
    item_key: str,
    item_geom: Column,
    payload: Sequence[str],
    predicate: str = "intersects",
    geom: str = "geometry",
    rank: Column | None = None,
    cell: float = 0.01,
    pick: str = "first",
    prefix: str = "poly_",
) -> DataFrame:
    """SP-03 / SP-04 / SP-05: each item geometry (multipolygon) gets the payload of the
    first (``pick='first'``) or last (``'last'``) polygon satisfying ``predicate``
    (``'within'`` or ``'intersects'``).

    Candidates come from the cells of the item's own bounds (Q-26 decision); an item
    spanning several cells is matched per cell and the choice is a minimum or maximum by item key
    (partial aggregation, so no item's rows gather in one task).
    Items without a match are kept with null payload.
    """
    rank = rank if rank is not None else F.col(payload[0])
    cells = polygon_cells(polygons, geom, cell, payload, rank)
    ig = item_geom
    ib = geo.bounds(ig)
    base = items.select(F.col(item_key), ig.alias("__ig"), ib.alias("__ib"))
    ex = base.withColumn("cx", F.explode(geo.cell_range(F.col("__ib.minx"), F.col("__ib.maxx"), cell))).withColumn(
        "cy", F.explode(geo.cell_range(F.col("__ib.miny"), F.col("__ib.maxy"), cell)))
    j = _join_cells(ex, cells, F.col("cx"), F.col("cy"), "inner")

    def ok(c):
        box = (c["b"]["minx"] <= F.col("__ib.maxx")) & (c["b"]["maxx"] >= F.col("__ib.minx")) & (
            c["b"]["miny"] <= F.col("__ib.maxy")) & (c["b"]["maxy"] >= F.col("__ib.miny"))
        # of the cells that both boxes share, only the one of the overlap's lower left corner tests
        box = box & (F.col("__cx") == geo.cell_of(F.greatest(c["b"]["minx"], F.col("__ib.minx")), cell)) & (
            F.col("__cy") == geo.cell_of(F.greatest(c["b"]["miny"], F.col("__ib.miny")), cell))
        if predicate == "within":
            return box & geo.polygon_within(F.col("__ig"), c["g"])
        return box & geo.polygons_intersect(F.col("__ig"), c["g"])

    best = _picked(j, item_key, F.filter("cands", ok), payload, pick)
    out = items.join(best, item_key, "left")
    return out.select(*[F.col(f"`{c}`") for c in items.columns],
                      *[F.col("__hit")[c].alias(prefix + c) for c in payload])


def sampled_overlap(
    items: DataFrame,
    polygons: DataFrame,
    item_key: str,
    item_geom: Column,
    payload: Sequence[str],
    n_samples: int = 20,
    seed: int = 0,
    geom: str = "geometry",
    rank: Column | None = None,
    cell: float = 0.01,
    prefix: str = "poly_",
) -> DataFrame:
    """SP-07: ``n_samples`` uniform points in the item's bounds; the item matches a
    polygon when one sample lies inside it; the last match (highest rank) wins.

    Samples come from a hash of (key, i, seed), so results do not depend on partitioning.
    """
    # dealt by key before the samples are made, so that a task's share does not hang on the files
    base = items.select(F.col(item_key), geo.bounds(item_geom).alias("__ib")).repartition(F.col(item_key))

    def unit(i: Column, salt: int) -> Column:
        h = F.xxhash64(F.col(item_key), i, F.lit(seed), F.lit(salt))
        return (F.pmod(h, F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)

    def sample(i: Column) -> Column:
        x = F.col("__ib.minx") + unit(i, 1) * (F.col("__ib.maxx") - F.col("__ib.minx"))
        y = F.col("__ib.miny") + unit(i, 2) * (F.col("__ib.maxy") - F.col("__ib.miny"))
        return F.struct(x.alias("x"), y.alias("y"), geo.cell_of(x, cell).alias("cx"), geo.cell_of(y, cell).alias("cy"))

    s = base.select(item_key, F.transform(F.sequence(F.lit(1), F.lit(n_samples)), sample).alias("__s"))
    at = F.array_distinct(F.transform("__s", lambda p: F.struct(p["cx"], p["cy"])))
    s = s.withColumn("__at", F.explode(at))  # a row for each cell that holds samples
    rank = rank if rank is not None else F.col(payload[0])
    cells = polygon_cells(polygons, geom, cell, payload, rank)
    j = _join_cells(s, cells, F.col("__at.cx"), F.col("__at.cy"), "inner")

    def holds(c: Column) -> Column:
        here = lambda p: (p["cx"] == F.col("__cx")) & (p["cy"] == F.col("__cy"))
        return F.exists("__s", lambda p: here(p) & geo.in_bounds(c["b"], p["x"], p["y"]) & geo.contains_point(c["g"], p["x"], p["y"], True))

    best = _picked(j, item_key, F.filter("cands", holds), payload, "last")
    out = items.join(best, item_key, "left")
    return out.select(*[F.col(f"`{c}`") for c in items.columns],
                      *[F.col("__hit")[c].alias(prefix + c) for c in payload])


def line_length_in_polygons(
    lines: DataFrame,
    polygons: DataFrame,
    line_key: str,
    line_col: str,
    payload: Sequence[str],
    geom: str = "geometry",
    rank: Column | None = None,
    cell: float = 0.01,
    pick: str = "last",
    project: bool = True,
    prefix: str = "poly_",
) -> DataFrame:
    """SP-08 / SP-09: length (metres in UTM 31N when ``project``) of each line inside the
    polygons it crosses; one polygon per line is kept (``pick='last'`` = reference
    parity, the highest rank with a positive length). Output: line columns, payload,
    ``length_in`` (null when no polygon holds a part of the line)."""
    rank = rank if rank is not None else F.col(payload[0])
    # Polygons are projected and their edges listed once; lines are projected once, before the explode.
    pg = geo.project_multipolygon(F.col(geom)) if project else F.col(geom)
    polys = polygons.where(F.col(geom).isNotNull()).select(
        rank.alias("__rank"), *[F.col(c).alias(f"__p_{c}") for c in payload], geo.bounds(F.col(geom)).alias("__pb"), pg.alias("__pg"))
    polys = polys.select("*", geo.bounds(F.col("__pg")).alias("__box"), geo.flat_edges(F.col("__pg")).alias("__pe")).drop("__pg")

    def celled(df: DataFrame, b: str, name: str) -> DataFrame:
        """A row for each cell of the bounds ``b``, with the least cell."""
        for axis in "xy":
            low, high = F.col(f"{b}.min{axis}"), F.col(f"{b}.max{axis}")
            df = df.withColumn(f"{name}0{axis}", geo.cell_of(low, cell)).withColumn(f"{name}{axis}", F.explode(geo.cell_range(low, high, cell)))
        return df.drop(b)

    cells = celled(polys.where("__rank is not null"), "__pb", "__p")
    ln = geo.project_line(F.col(line_col)) if project else F.col(line_col)
    # dealt by key, so that a task's share does not hang on the files
    dealt = lines.where(F.col(line_key).isNotNull()).select(line_key, line_col).repartition(F.col(line_key))
    base = dealt.select(F.col(line_key), ln.alias("__ln"), geo.line_bounds(F.col(line_col)).alias("__lb"))
    base = base.select(line_key, "__lb", geo.flat_points(F.col("__ln")).alias("__pts"), geo.line_bounds(F.col("__ln")).alias("__lbox"))
    on = F.lit(True)
    for axis in "xy":
        # of the cells that both share, only the least one tests the pair
        on = on & (F.col(f"__l{axis}") == F.col(f"__p{axis}")) & (F.col(f"__l{axis}") == F.greatest(f"__l0{axis}", f"__p0{axis}"))
        on = on & (F.col(f"__lbox.min{axis}") <= F.col(f"__box.max{axis}")) & (F.col(f"__lbox.max{axis}") >= F.col(f"__box.min{axis}"))
    hits = celled(base, "__lb", "__l").join(cells, on).withColumn("len", geo.clipped_lengths(F.col("__pts"), F.col("__pe")))
    keep = F.struct("__rank", *[F.col(f"__p_{c}").alias(c) for c in payload], "len")
    best = hits.where(F.col("len") > 0).groupBy(line_key).agg((F.max if pick == "last" else F.min)(keep).alias("__hit"))
    out = lines.join(best, line_key, "left")
    return out.select(*[F.col(f"`{c}`") for c in lines.columns],
                      *[F.col("__hit")[c].alias(prefix + c) for c in payload],
                      F.col("__hit.len").alias("length_in"))


def dissolve(polygons: DataFrame, key: Column, geom: str = "geometry") -> DataFrame:
    """SP-12: polygons grouped per key: summed area, area-weighted centroid and number of parts. The
    parts stay rows of ``polygons``; no key's geometry is gathered. Interiors are assumed disjoint
    (districts), so no overlay is needed and the area is exact."""
    parts = polygons.select(key.alias("key"), geo.area(F.col(geom)).alias("a"), geo.centroid(F.col(geom)).alias("c"))
    return parts.groupBy("key").agg(
        F.sum("a").alias("area"),
        (F.sum(F.col("a") * F.col("c.x")) / F.sum("a")).alias("centroid_x"),
        (F.sum(F.col("a") * F.col("c.y")) / F.sum("a")).alias("centroid_y"),
        F.count(F.lit(1)).alias("n_parts"),
    )


def hexbin_counts(
    df: DataFrame, lon: str, lat: str, extent: Sequence[float], nx_hexagon: int = 10, min_count: int = 1
) -> DataFrame:
    """SP-17: counts of points per pointy-top hexagon; ``nx_hexagon`` hexagons across the
    x extent (x0, y0, x1, y1). Hex id is (q, r) axial coordinates by cube rounding."""
    x0, y0, x1, _ = extent
    size = (x1 - x0) / nx_hexagon / math.sqrt(3.0)
    px = (F.col(lon) - F.lit(x0)) / F.lit(size)
    py = (F.col(lat) - F.lit(y0)) / F.lit(size)
    qf = F.lit(math.sqrt(3.0) / 3.0) * px - F.lit(1.0 / 3.0) * py
    rf = F.lit(2.0 / 3.0) * py
    sf = -qf - rf
    q, r, s = F.round(qf), F.round(rf), F.round(sf)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q2 = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    r2 = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    cnt = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(
        q2.cast("bigint").alias("hex_q"), r2.cast("bigint").alias("hex_r")).agg(F.count(F.lit(1)).alias("count"))
    return cnt.where(F.col("count") >= min_count)
